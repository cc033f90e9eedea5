"""One function per operator; each takes and returns DataFrames."""

"""Personal data: fixed patterns, and identifiers that their contexts give away.

The fixed patterns (e-mail, IP address, card, phone) give the base spans, which
always stay. They are also the seeds of a bootstrap over contexts: the words
left and right of a seed are lexical patterns, other tokens that look like
identifiers are instances, and patterns and instances form a graph. In each
round a pattern's confidence is the mean score of its instances (smoothed), and
an instance's score follows from its patterns (noisy or). Instances that reach a
high score count as seeds from then on, and rounds go on until none is added and
scores rest. Instances that end with a high score are unseen identifiers; their places are added as ``other``.

All of it is built-in DataFrame work. The text is read once, into a table of
matches with a few dozen characters around each; places come from the lengths of
what lies between matches. Matches are dealt by document and edges of the graph
are counted before they are shuffled.

The patterns are written so that Java's matcher needs linear time and constant
stack on any text: runs are entered at their start only, and repeats possessive.
Where a run can match at all, it matches from its start (or from the end of the
match before), so the matches are those of the plain forms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewright.functions.skew import broadcast_if_small, packed, salted_lookup, small_enough
from casewright.llm.registry import query, table
from casewright.llm.rows import free_name, numbered
from casewright.session import cut_lineage

# Base kinds in their order.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # A token with a digit or an at sign in it.
    "other": r"(?<![A-Za-z0-9_+/.@-])[A-Za-z0-9_+/.@-]*[0-9@][A-Za-z0-9_+/.@-]*",
}
# What a text has to hold for a pattern to be worth trying.
NEEDS = {"email": "@", "phone": "+"}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
AROUND = 40

# Rounds at least; more follow while an instance is added or a score rises by this much.
ROUNDS = 3
RISE = 0.01
# A pattern speaks for an instance from this many seeds on; an instance is accepted from this score on.
SEEDS = 3
ACCEPT = 0.9
SMOOTHING = 2.0
# A graph of so many edges and bytes is joined by broadcast, in a few partitions.
FEW_EDGES = 100_000
FEW_BYTES = 16 << 20
# Type that scores are added in.
EXACT = "decimal(28,14)"


def _matches(kind: str, has: Column) -> tuple[Column, Column]:
    """What lies between the matches of a pattern, and the matches."""
    pattern, none = F.lit(PATTERNS[kind]), F.array().cast("array<string>")
    able = has if kind not in NEEDS else has & F.contains("text", F.lit(NEEDS[kind]))
    return F.when(able, F.split("text", PATTERNS[kind], -1)).otherwise(none), F.when(able, F.regexp_extract_all("text", pattern, F.lit(0))).otherwise(none)


def matches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, kind, at, before, tail, hit, head): all matches of all patterns, and an entry without kind for each row."""
    lean = numbered(docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")), "row")
    has = F.col("text").rlike("[0-9@]")
    cut = lean.select("row", "id", *[c.alias(f"{name}_{kind}") for kind in PATTERNS for name, c in zip(("gaps", "hits"), _matches(kind, has), strict=True)])

    def entry(kind: str | None, at, before, tail, hit, head) -> Column:
        return F.struct(
            F.lit(kind).cast("string").alias("kind"), at.alias("at"), before.alias("before"), tail.alias("tail"), hit.alias("hit"), head.alias("head")
        )

    def found(kind: str) -> Column:
        gaps, hits = f"gaps_{kind}", f"hits_{kind}"
        return F.transform(
            hits, lambda hit, i: entry(
                kind, i, F.length(F.get(gaps, i)), F.right(F.get(gaps, i), F.lit(AROUND)), hit, F.left(F.get(gaps, i + 1), F.lit(AROUND))
            ),
        )

    nothing = F.lit(None).cast("string")
    own = F.array(entry(None, F.lit(0), F.lit(0), nothing, nothing, nothing))
    return cut.select("row", "id", F.explode(F.concat(own, *[found(k) for k in PATTERNS])).alias("m")).select("row", "id", "m.*")


def _luhn(digits: Column) -> Column:
    """Luhn's test of up to 19 digits."""
    backwards = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(backwards, i, F.lit(1)).cast("int")
        doubled = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: Column, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    n = F.length(digits)
    ip = hit.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", ip)
        .when(kind == "card", F.when(n.between(14, 19), _luhn(digits)).otherwise(False))
        .when(kind == "phone", n.between(10, 15))
        .otherwise(False)
    )


def placed(found: DataFrame) -> DataFrame:
    """Matches with their start, end (exclusive, in code points) and whether they are base spans."""
    dealt = found.repartition("row")
    order = Window.partitionBy("row", "kind").orderBy("at")
    until = F.sum(F.col("before") + F.coalesce(F.length("hit"), F.lit(0))).over(order)
    spans = dealt.withColumn("end", until).withColumn("start", F.col("end") - F.length("hit"))
    return spans.withColumn("base", F.coalesce(_valid(F.col("kind"), F.col("hit")), F.lit(False)))


def _identifiers(spans: DataFrame) -> DataFrame:
    """Base spans, and other tokens that look like identifiers and touch no base span."""
    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("row").orderBy(F.col("start").desc(), F.col("end").desc()).rowsBetween(Window.unboundedPreceding, 0)
    own = F.col("base")
    # A token without the full stop or sign it ends or begins with.
    lead, bare = F.regexp_extract("hit", r"^[./+-]*", 0), F.regexp_extract("hit", r"^[./+-]*(.*?)[./+-]*$", 1)
    token = F.col("kind") == "other"
    trimmed = spans.where("kind IS NOT NULL").where(own | token).select(
        "row", "base", "tail", "head", F.when(token, bare).otherwise(F.col("hit")).alias("hit"),
        F.when(token, F.col("start") + F.length(lead)).otherwise(F.col("start")).alias("start"), "kind",
    ).withColumn("end", F.col("start") + F.length("hit"))
    reach = F.coalesce(F.max(F.when(own, F.col("end"))).over(before), F.lit(-1))
    ahead = F.min(F.when(own, F.col("start"))).over(after)
    clear = (reach <= F.col("start")) & (ahead.isNull() | (ahead >= F.col("end")))
    marked = trimmed.withColumn("clear", clear)
    shaped = (F.length("hit") >= 8) & (
        (F.col("hit").rlike("[A-Za-z]") & F.col("hit").rlike("[0-9]")) | F.contains("hit", F.lit("@")) | (F.length(F.regexp_replace("hit", "[^0-9]", "")) >= 9)
    )
    return marked.where(own | (F.col("clear") & shaped))


def bootstrap(identifiers: DataFrame, rounds: int = ROUNDS, accept: float = ACCEPT) -> DataFrame:
    """(instance): identifiers that no pattern names but high-confidence contexts do.

    Scores only rise from round to round, so the rounds come to an end.
    """
    left = F.lower(F.regexp_extract("tail", r"(\S{1,40})\s*$", 1))
    right = F.lower(F.regexp_extract("head", r"^\s*(\S{1,40})", 1))
    contexts = F.array(F.struct(F.lit("left").alias("side"), left.alias("word")), F.struct(F.lit("right").alias("side"), right.alias("word")))
    edges = (
        identifiers.select(F.lower("hit").alias("instance"), "base", F.explode(contexts).alias("c"))
        .select("instance", "base", F.concat("c.side", F.lit(" "), "c.word").alias("pattern"))
        .where("pattern NOT LIKE '% '")
        .groupBy("pattern", "instance").agg(F.bool_or("base").alias("seed"))
    )
    edges = cut_lineage(edges)
    few = max(1, edges.count()) if small_enough(edges, FEW_EDGES, FEW_BYTES) else 0
    edges = packed(edges, few)

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(packed(df, few)) if few else df

    scores = edges.groupBy("instance").agg(F.bool_or("seed").alias("known")).select("instance", "known", F.col("known").cast("int").cast("double").alias("score"))
    scores = packed(scores, few)
    accepted, done = -1, 0
    while True:
        confidence = edges.join(small(scores), "instance").groupBy("pattern").agg(
            (F.sum(F.col("score").cast(EXACT)).cast("double") / (F.count(F.lit(1)) + SMOOTHING)).alias("confidence"), F.count(F.when(F.col("known") | (F.col("score") >= accept), 1)).alias("seeds")
        ).where(F.col("seeds") >= SEEDS)
        # Sums as decimals, so that no order of rows decides what is accepted.
        doubt = F.sum(F.log(1 - F.col("confidence")).cast(EXACT)).cast("double")
        # A pattern may have a large share of all instances, so its rows are spread over several tasks.
        told = edges.join(small(confidence), "pattern") if few else salted_lookup(edges, confidence, "pattern", "instance")
        spoken = told.groupBy("instance").agg((1 - F.exp(doubt)).alias("heard"))
        joined = scores.select("instance", "known", F.col("score").alias("was")).join(small(spoken), "instance", "left")
        new = F.when(F.col("known"), 1.0).otherwise(F.coalesce("heard", F.lit(0.0)))
        scores = cut_lineage(joined.select("instance", "known", "was", new.alias("score")))
        state = scores.agg(F.count(F.when(F.col("score") >= accept, 1)).alias("n"), F.max(F.col("score") - F.col("was")).alias("rise")).first()
        grown, accepted, done = state["n"] > accepted, state["n"], done + 1
        if done >= rounds and not grown and (state["rise"] or 0.0) < RISE:
            break
    return scores.where(~F.col("known") & (F.col("score") >= accept)).select("instance")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id_col, spans): one row per document with all spans in order, each (start, rank, kind, end, base).

    ``row`` is the row's number in ``docs``. Null counts as empty and has no spans;
    repeated rows and null ids each give a row; other columns are not read; an
    empty table gives no rows.
    """
    spans = cut_lineage(placed(matches(docs, id_col, text_col)))
    identifiers = _identifiers(spans)
    unseen = bootstrap(identifiers)
    added = identifiers.where("NOT base").withColumn("instance", F.lower("hit")).join(unseen, "instance", "left_semi")
    rank = F.array_position(F.array(*[F.lit(k) for k in (*KINDS, "other")]), F.col("kind")).cast("int")
    one = F.struct(F.col("start").cast("long").alias("start"), rank.alias("rank"), F.col("kind"), F.col("end").cast("long").alias("end"), F.col("base"))
    nothing = F.lit(None).cast("long")
    rows = spans.where("kind IS NULL").select("row", "id", F.lit(None).cast("struct<start:bigint,rank:int,kind:string,end:bigint,base:boolean>").alias("span"))
    known = spans.where("base").select("row", nothing.alias("id"), one.alias("span"))
    more = added.select("row", nothing.alias("id"), one.alias("span"))
    kind = docs.schema[id_col].dataType
    known, more = known.withColumn("id", F.lit(None).cast(kind)), more.withColumn("id", F.lit(None).cast(kind))
    return rows.unionByName(known).unionByName(more).groupBy("row").agg(F.max("id").alias(id_col), F.sort_array(F.collect_list("span")).alias("spans"))


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, with exactly its columns, and ``[kind]`` in place of each span of a text.

    A span that begins within the one before is masked with it. Texts without a
    span stay as they are, null included; all rows stay. ``docs`` has to be a table
    read from files or a checkpoint, as its rows are told apart by their place.
    """
    row, spans = free_name(docs, "_row"), free_name(docs, "_spans")
    found = cut_lineage(find(docs, id_col, text_col).where(F.size("spans") > 0).select(F.col("row").alias(row), F.col("spans").alias(spans)))
    text = F.col(text_col)
    # Pieces between spans come from running ends: (end so far, text so far).
    start = F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<string>").alias("parts"))

    def step(state: Column, span: Column) -> Column:
        gap = F.substr(text, (state["end"] + 1).cast("int"), (span["start"] - state["end"]).cast("int"))
        longer = F.concat(state["parts"], F.array(gap, F.concat(F.lit("["), span["kind"], F.lit("]"))))
        inside = span["start"] < state["end"]
        return F.struct(F.greatest(state["end"], span["end"]).alias("end"), F.when(inside, state["parts"]).otherwise(longer).alias("parts"))

    def finish(state: Column) -> Column:
        return F.array_join(F.concat(state["parts"], F.array(F.substr(text, (state["end"] + 1).cast("int"), F.length(text)))), "")

    masked = F.when(F.col(spans).isNull(), text).otherwise(F.aggregate(F.col(spans), start, step, finish))
    marked = numbered(docs, row).join(broadcast_if_small(found), row, "left")
    return marked.select(*[masked.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


@query()
def op9_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document."""
    found = find(table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))

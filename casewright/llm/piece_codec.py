"""Encoding and decoding with a merge-type piece model, by a table over prefixes.

For every prefix of a text, its encoding ends in one certain piece. That piece is
found among the pieces that end at the prefix's last character (matches of an
automaton over all pieces): it is the one that is compatible with the last piece
of the prefix before it. Two pieces are compatible when merging their joined
characters gives just these two. The ids then follow from the table backwards.
Time is linear in the text, for words of any length.

Two properties of a model, read from its vocabulary, let a text be cut before
the table is built: pieces carry the word mark at their start only, and some
characters are in no longer piece. Nothing merges across such places, so equal
segments have equal ids wherever they stand, and each is encoded once.

Runs of word marks are pieces that all share one lowest score. Scores do not
order them; they are merged last, from the left, as the library's queue does.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.llm.registry import query, table
from casewright.llm.rows import kept_in_worker

MARK = "▁"
# Segments of one generation, and pairs, that a Python worker remembers.
MEMORY_SEGMENTS = 300_000
MEMORY_PAIRS = 400_000


class PieceCodec:
    """The ids the model's own library gives, from a table of last pieces."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(sp.vocab_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        runs = {len(p) for p in self.ids if len(p) > 1 and not p.strip(MARK)}
        self.runs = {n: self.ids[MARK * n] for n in runs | {1}}
        self.scores = {p: sp.get_score(i) for p, i in self.ids.items() if len(p) == 1 or p.strip(MARK)}
        if any(MARK in p.lstrip(MARK) for p in self.scores) or any(p.startswith(MARK * 2) for p in self.scores):
            raise ValueError("a piece of this model has a word mark after its start")
        longer = [p for p in self.scores if len(p) > 1]
        ranks = [self.scores[p] for p in longer]
        if len(set(ranks)) < len(ranks):
            raise ValueError("two pieces of this model share a score, so merges are not ordered")
        joined = {c for p in longer for c in p}
        self.automaton = ahocorasick.Automaton()
        # A piece that merging its own characters does not give back is never in an encoding.
        self.merged: dict[str, list[str]] = {}
        for p in longer:
            if self._merge(p) == [p]:
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        # Signs that no piece has after a letter or a digit: a word ends before them.
        signs = {c for c in joined - {MARK} if not c.isalnum()}
        while bad := {y for p in longer for x, y in zip(p, p[1:], strict=False) if y in signs and x not in signs and x != MARK}:
            signs -= bad
        sign = "".join(re.escape(c) for c in sorted(signs)) or MARK
        inner = "".join(re.escape(c) for c in sorted(joined - {MARK}))
        word = "".join(re.escape(c) for c in sorted(joined - {MARK} - signs))
        # A segment is a run of marks, or signs and then a word after at most one mark, or characters that do not merge.
        self.segment = re.compile(f"{MARK}?(?:[{word}]+|[{sign}]+[{word}]*)|{MARK}+(?![{inner}])|[^{inner}{MARK}]+")
        self.compatible: dict[tuple[str, str], bool] = {}
        # Segments met lately, in two generations: what is not asked for again while one fills is forgotten.
        self.known: dict[str, tuple[int, ...]] = {}
        self.before: dict[str, tuple[int, ...]] = {}

    def _merge(self, text: str) -> list[str]:
        """Merge characters by score, best first and leftmost among equals; for short strings."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _fits(self, pair: tuple[str, str]) -> bool:
        if len(self.compatible) > MEMORY_PAIRS:
            self.compatible.clear()
        found = self.compatible[pair] = self._merge(pair[0] + pair[1]) == list(pair)
        return found

    def _single(self, char: str) -> tuple[int, ...]:
        """A character's own piece, else its bytes."""
        found = self.ids.get(char)
        return (found,) if found is not None else tuple(self.library.piece_to_id(f"<0x{b:02X}>") for b in char.encode("utf-8"))

    def _run(self, length: int) -> tuple[int, ...]:
        """Word marks, merged from the left."""
        parts: list[int] = []
        todo = [1] * length
        todo.reverse()
        while todo:
            parts.append(todo.pop())
            while len(parts) > 1 and parts[-2] + parts[-1] in self.runs:
                last = parts.pop()
                parts[-1] += last
        return tuple(self.runs[n] for n in parts)

    def _table(self, segment: str) -> tuple[int, ...]:
        """Ids of characters that merge: the last piece of every prefix, then backwards."""
        last: list[str] = []
        seen, compatible = 0, self.compatible
        for end, piece in self.automaton.iter(segment):  # ends ascend; at one end the longest piece comes first
            if end < seen:
                continue
            while seen < end:
                last.append(segment[seen])
                seen += 1
            before = end - len(piece)
            if before >= 0:
                pair = (last[before], piece)
                fits = compatible.get(pair)
                if fits is None:
                    fits = self._fits(pair)
                if not fits:
                    continue
            last.append(piece)
            seen += 1
        last.extend(segment[seen:])
        out: list[tuple[int, ...]] = []
        at = len(segment) - 1
        while at >= 0:
            out.append(self._single(last[at]))
            at -= len(last[at])
        return tuple(i for ids in reversed(out) for i in ids)

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, without begin or end ids."""
        if len(self.known) > MEMORY_SEGMENTS:
            self.before, self.known = self.known, {}
        known, older, mark = self.known, self.before, self.runs[1]
        out: list[int] = []
        waiting = 0
        for segment in self.segment.findall(self.library.normalize(text)):
            ids = known.get(segment)
            if ids is None:
                if not segment.strip(MARK):
                    waiting = len(segment)
                    continue
                ids = older.get(segment)
                known[segment] = ids = self._table(segment) if ids is None else ids
            if waiting:
                # The mark before a word joins the run if nothing in the word took it.
                if ids[0] == mark and segment[0] == MARK:
                    out += self._run(waiting + 1)
                    ids = ids[1:]
                else:
                    out += self._run(waiting)
                waiting = 0
            out += ids
        if waiting:
            out += self._run(waiting)
        return out

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """(id_col, ids, decoded): ids of each whole text and what they decode to.

    Null counts as empty and has no ids. Repeated rows and rows with a null id
    each give a row; other columns are not read; an empty table gives no rows.
    Without ``keep_text`` the ids and the decoded text are replaced by n_tokens
    and their SHA-256, made where the text is.
    """
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    kind = docs.schema[id_col].dataType.simpleString()

    def sha(value: str) -> str:
        return hashlib.sha256(value.encode("utf-8")).hexdigest()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = kept_in_worker(f"pieces {path}", lambda: PieceCodec(path))
        for batch in batches:
            coded = [codec.encode(t or "") for t in batch["text"]]
            decoded = [codec.decode(ids) for ids in coded]
            if keep_text:
                yield pd.DataFrame({"id": batch["id"], "ids": coded, "decoded": decoded})
            else:
                yield pd.DataFrame(
                    {
                        "id": batch["id"], "n_tokens": [len(ids) for ids in coded],
                        "ids_sha256": [sha(",".join(map(str, ids))) for ids in coded], "decoded_sha256": [sha(t) for t in decoded],
                    }
                )

    schema = "id string, ids array<int>, decoded string" if keep_text else "id string, n_tokens long, ids_sha256 string, decoded_sha256 string"
    out = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInPandas(work, schema)
    return out.select(F.col("id").cast(kind).alias(id_col), *out.columns[1:])


@query()
def op5_piece_codec(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded and decoded."""
    return round_trip(table(spark, folder, "documents"), keep_text=False)

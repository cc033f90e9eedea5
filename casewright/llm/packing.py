"""Packing of tokenised documents into sequences of fixed length.

Each document is cut into full pieces and a rest. Documents are dealt at random
into groups, and each group is packed on its own by first-fit decreasing: pieces
in descending length, each into the first sequence with room. A tournament tree
over the free room of all sequences finds that sequence in log(n) steps.

Only one short row per document (its piece checksums) leaves the task that
tokenised it; token ids are never shuffled. A group holds about ``GROUP``
documents at any corpus size, so the number of groups grows with the corpus and
a group never outgrows a task.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.llm.registry import query, table
from casewright.llm.rows import kept_in_worker
from casewright.session import cut_lineage, rows_at_once

CAPACITY = 2048
GROUP = 4096
SEPARATOR = 1
SEED = 7
# The mark of a token that ends a word, and signs that close one and are a piece of their own.
END = "</w>"
CLOSING = ".,;:!?)"
SPECIAL = b"<|"
LAST = re.compile(rb"([.,])(?<=[a-z][.,])(?=[ \n])")
# Documents a Python worker gets at once, and words of one generation that it remembers.
BATCH = 1024
MEMORY_WORDS = 500_000


class WordEncoder:
    """Ids of a tokenizer that drops white space, as little-endian unsigned 32-bit bytes.

    White space separates words for such a tokenizer whatever stands around
    them, so a word has the same ids in every text and is encoded only once.
    """

    def __init__(self, path: str, memory: int = MEMORY_WORDS):
        from tokenizers import Tokenizer

        # A task has one core; threads of the library would only wait for each other.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith(END)
        self.memory = memory
        # Words met lately, in two generations: what is not asked for again while one fills is forgotten.
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def _learn(self, fresh: list[bytes]) -> None:
        """Encode words that are not known yet.

        Letters make one piece, and closing signs after them another, each with one
        token that ends it; such words are encoded in one text and told apart by
        these ends. All others are encoded one by one.
        """
        plain = [w for w in fresh if w.isalpha()]  # ASCII letters
        self._learn_together(plain, [w.decode() for w in plain], np.ones(len(plain), np.int64))
        rest = [w for w in fresh if w not in self.known]
        words = [w.decode("utf-8") for w in rest]
        cores = [w.rstrip(CLOSING) for w in words]
        some = [i for i, core in enumerate(cores) if core.isalpha()]
        self._learn_together([rest[i] for i in some], [words[i] for i in some], np.array([1 + (len(cores[i]) < len(words[i])) for i in some], np.int64))
        rest = [w for w in rest if w not in self.known]
        coded = self.tokenizer.encode_batch_fast([w.decode("utf-8") for w in rest], add_special_tokens=False)
        self.known.update(zip(rest, (np.array(c.ids, "<u4").tobytes() for c in coded), strict=True))

    def _learn_together(self, keys: list[bytes], words: list[str], pieces: np.ndarray) -> None:
        """Encode words of so many pieces each in one text; leaves them unknown if the ends do not add up."""
        if not keys:
            return
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) == pieces.sum():  # else a letter is not one after folding
            cuts = (4 * ends[np.cumsum(pieces) - 1]).tolist()
            data = ids.tobytes()
            self.known.update(zip(keys, [data[a:b] for a, b in zip([0, *cuts], cuts, strict=False)], strict=True))

    @staticmethod
    def _words(text: bytes) -> list[bytes]:
        """Words between ASCII white space, in lower case and without the full stop or comma after a letter, which is a word then."""
        # The tokenizer folds case itself, but its special tokens are looked for before that.
        return (text if SPECIAL in text else LAST.sub(rb" \1", text.lower())).split()

    def encode(self, texts: list[bytes] | list[str]) -> list[bytes]:
        """Ids of each text; only a few texts at a time are held a second time, as bytes and words."""
        out = []
        for at in range(0, len(texts), 256):
            if len(self.known) > self.memory:
                self.before, self.known = self.known, {}
            split = [self._words(text.encode("utf-8") if isinstance(text, str) else text or b"") for text in texts[at : at + 256]]
            fresh = set().union(*split).difference(self.known)
            self.known.update((w, self.before[w]) for w in fresh.intersection(self.before))
            self._learn(list(fresh.difference(self.before)))
            out += [b"".join(map(self.known.__getitem__, words)) for words in split]
        return out


def token_rows(docs: DataFrame, path: str, id_col: str, text_col: str, capacity: int, memory: int = MEMORY_WORDS) -> DataFrame:
    """One row per document: number of tokens (with the separator) and a checksum for each ``capacity`` of them."""
    separator = np.array([SEPARATOR], "<u4").tobytes()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = kept_in_worker(f"words {path} {memory}", lambda: WordEncoder(path, memory))
        for batch in batches:
            tokens, sums = [], []
            for ids in encoder.encode(batch["text"].tolist()):
                ids += separator
                tokens.append(len(ids) // 4)
                sums.append([zlib.crc32(ids[at : at + 4 * capacity]) for at in range(0, len(ids), 4 * capacity)])
            yield pd.DataFrame({"id": batch["id"], "tokens": tokens, "sums": sums})

    lean = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return lean.mapInPandas(work, "id string, tokens long, sums array<long>")


class RoomTree:
    """Tournament tree over the free room of sequences: each inner node has the larger room of its two children."""

    def __init__(self, leaves: int, capacity: int):
        self.size = 1 << max(0, leaves - 1).bit_length()
        self.room = [capacity] * (2 * self.size)

    def first_fit(self, need: int) -> tuple[int, int]:
        """Take ``need`` from the first leaf that has it; returns the leaf and the room it had."""
        room, node = self.room, 1
        while node < self.size:
            node *= 2
            if room[node] < need:
                node += 1
        leaf, had = node - self.size, room[node]
        room[node] = had - need
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
        return leaf, had


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece; full pieces get sequences of their own, at the end."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    part = np.flatnonzero(lengths < capacity)
    part = part[np.argsort(-lengths[part], kind="stable")]
    tree = RoomTree(max(1, len(part)), capacity)
    used = 0
    for at, need in zip(part.tolist(), lengths[part].tolist(), strict=True):
        leaf, had = tree.first_fit(need)
        sequence[at], offset[at] = leaf, capacity - had
        used = max(used, leaf + 1)
    full = np.flatnonzero(lengths == capacity)
    sequence[full] = used + np.arange(len(full))
    return sequence, offset


def pack(
    docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, group: int = GROUP,
    memory: int = MEMORY_WORDS,
) -> DataFrame:
    """Pieces of all documents with the sequence and offset each of them has.

    ``(id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset)``. A null
    or empty text is one piece with the separator alone. Repeated rows and rows
    with a null id are packed like any other; other columns are not read. An
    empty table gives no rows. A text longer than ``capacity`` tokens is cut at
    its multiples; no other cuts are made. A Python worker remembers up to twice
    ``memory`` words; fewer cost time, not results.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")
    kind = docs.schema[id_col].dataType.simpleString()
    # Written once: the groups depend on the number of rows, and the row numbers that deal them have to be the same in retries.
    with rows_at_once(docs.sparkSession, BATCH):
        coded = cut_lineage(token_rows(docs, path, id_col, text_col, capacity, memory))
    groups = max(1, -(-coded.count() // group))
    dealt = coded.withColumn("part", F.pmod(F.xxhash64(F.lit(SEED), "id", F.monotonically_increasing_id()), F.lit(groups)))

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["id", "tokens"], kind="stable")
        tokens = rows["tokens"].to_numpy(np.int64)
        pieces = -(-tokens // capacity)
        doc = np.repeat(np.arange(len(rows)), pieces)
        start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
        length = np.minimum(capacity, tokens[doc] - start)
        sequence, offset = first_fit_decreasing(length, capacity)
        return pd.DataFrame(
            {
                "id": rows["id"].to_numpy()[doc], "start": start, "length": length, "ids_crc32": np.concatenate(rows["sums"].to_numpy()),
                "doc_tokens": tokens[doc], "sequence_id": (rows["part"].iloc[0] << 32) + sequence, "offset": offset,
            }
        )

    schema = "id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    packed = dealt.groupBy("part").applyInPandas(work, schema)
    return packed.select(F.col("id").cast(kind).alias(id_col), *packed.columns[1:])


@query()
def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack(table(spark, folder, "documents"))

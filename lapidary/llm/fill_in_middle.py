"""Fill-in-the-middle: documents cut at two seeded token boundaries and put together as prefix-suffix-middle or suffix-prefix-middle.

A distinct-text index is built first. Identical texts are grouped by their content (the grouping compares whole texts, and collapses copies
before they are shuffled), and the ids of its documents stay with each text, so that texts move once; a text with very many copies is dealt
over several groups. Of each group's text the ends of its tokens, in code points, are found once and kept as an Elias-Fano list: the low
bits of each end packed, the high bits as a bit vector with a one for each end. The list is joined to the group's documents, and each
selects its two cuts from it by rank.

A token is white space (space, U+0009..U+000D) with the word after it, or the white space that ends a text.

Defined results: a null or empty text has no tokens and stays plain; a null id is seeded as the empty string; repeated rows get equal
results; an empty table gives an empty result; other columns are not read. A text that holds a marker stays plain.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, buffers, mapped, slices, words_at

SEED, FORM_SHARE, SUFFIX_FIRST, SLICE_BYTES, ROWS = 42, 50, 80, 1 << 20, 5_000
#: Markers of the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_BLANK = np.isin(np.arange(256), SPACE)


class EliasFano(NamedTuple):
    """Ascending numbers: `bits` low bits of each, packed one after another, and a bit vector of the rest in unary."""

    count: int
    bits: int
    low: bytes
    high: bytes

    @staticmethod
    def of(ends: np.ndarray, most: int) -> EliasFano:
        """Of numbers up to `most`."""
        if not len(ends):
            return EliasFano(0, 0, b"", b"")
        bits = max(0, (most // len(ends)).bit_length() - 1)
        low = (ends[:, None] >> np.arange(bits) & 1).astype(np.uint8)
        high = np.zeros((most >> bits) + len(ends) + 1, np.uint8)
        high[(ends >> bits) + np.arange(len(ends))] = 1
        return EliasFano(len(ends), bits, np.packbits(low, bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes())

    def ranks(self) -> np.ndarray:
        """How many ones end with each byte of the bit vector."""
        return np.cumsum(np.bitwise_count(np.frombuffer(self.high, np.uint8)), dtype=np.int64)

    def select(self, i: int, ranks: np.ndarray) -> int:
        """The number at place i."""
        byte = int(np.searchsorted(ranks, i, "right"))
        before = int(ranks[byte - 1]) if byte else 0
        ones = [b for b in range(8) if self.high[byte] >> b & 1]
        at, low = 8 * byte + ones[i - before], 0
        if self.bits:
            first = i * self.bits
            part = int.from_bytes(self.low[first // 8 : (first + self.bits + 7) // 8], "little")
            low = part >> (first % 8) & ((1 << self.bits) - 1)
        return (at - i) << self.bits | low


def token_ends(texts: pa.Array) -> list[tuple[np.ndarray, int]]:
    """The ends of each text's tokens and its length, in code points."""
    raw, offsets = buffers(texts)
    _, ends = words_at(raw, offsets, _BLANK)
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80, dtype=np.int64)])
    found = np.split(ends, np.searchsorted(ends, offsets[1:-1], "right"))
    out = []
    for own, a, z in zip(found, offsets[:-1], offsets[1:], strict=True):
        if z > a and _BLANK[raw[z - 1]]:
            own = np.append(own, z)
        out.append((chars[own] - chars[a], int(chars[z] - chars[a])))
    return out


def text_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each distinct text with the ids of its documents. A text with more than a quarter of a shuffle partition's share of the documents has
    several groups; there are at most four such texts a partition, so the driver can name their hashes (a hash that two texts share only
    makes more groups)."""
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = texts.groupBy(F.xxhash64("text").alias("key")).agg(F.count("*").alias("n"))
    total = texts.count()
    share = max(1_000, total // (4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    hot: dict[int, list[int]] = {}
    for r in counts.where(F.col("n") > share).collect():
        hot.setdefault(1 << (-(-r.n // share) - 1).bit_length(), []).append(r.key)
    parts = F.lit(1)
    for n, keys in hot.items():
        parts = F.when(F.xxhash64("text").isin(keys), n).otherwise(parts)
    part = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), parts)
    return texts.withColumn("part", part).groupBy("text", "part").agg(F.collect_list(F.struct("id")).alias("ids")).select("text", "ids")


class Cut(NamedTuple):
    """A document's form and the two ranks at which it is cut."""

    form: str
    first: int
    second: int


def choose(doc_id, text: str, n: int, seed: int = SEED) -> Cut:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= FORM_SHARE:
        return Cut("plain", 0, 0)
    a, b = h1 % (n + 1), h2 % (n + 1)
    return Cut("spm" if h4 % 100 < SUFFIX_FIRST else "psm", min(a, b), max(a, b))


def joined(form: str, text: str, first: int, second: int) -> str:
    """The text of a form, cut at two code points."""
    if form == "plain":
        return text
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}" if form == "psm" else f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"


def restored(form: str, output: str) -> str:
    """The document from its output and form alone."""
    if form == "plain":
        return output
    outer, inner = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    head, _, middle = output.removeprefix(outer).rpartition(MIDDLE)
    one, _, two = head.partition(inner)
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return prefix + middle + suffix


def _select(docs: DataFrame, id_col: str, text_col: str, make, schema: str, names: list[str], seed: int) -> DataFrame:
    """Calls make(text, tokens, form, first, second) for each document, first and second in code points."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = dict(docs.dtypes)[id_col]
    fields = list(to_arrow_schema(StructType.fromDDL(f"id {kind}, {schema}")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", SLICE_BYTES):
                out: list[tuple] = []
                for text, ids, (ends, chars) in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), token_ends(b.column(0)), strict=True):
                    index = EliasFano.of(ends, chars)
                    ranks = index.ranks()
                    for x in ids:
                        c = choose(x["id"], text, index.count, seed)
                        first, second = (index.select(i - 1, ranks) if i else 0 for i in (c.first, c.second))
                        out.append((x["id"], *make(text, index.count, c.form, first, second)))
                        if len(out) == ROWS:
                            yield batch_of(out)
                            out = []
                if out:
                    yield batch_of(out)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], names=["id", *names])

    return mapped(text_groups(docs, id_col, text_col), cut, f"id {kind}, {schema}").withColumnRenamed("id", id_col)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """id_col, form and output, the training text of each document."""
    return _select(docs, id_col, text_col, lambda t, n, form, a, z: (form, joined(form, t, a, z)), "form string, output string", ["form", "output"], seed)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """id_col, n (tokens), form, prefix_chars, middle_chars (null if plain), output_sha256, restored_sha256."""

    def make(text: str, n: int, form: str, first: int, second: int) -> tuple:
        output = joined(form, text, first, second)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (output, restored(form, output))]
        return (n, form, *((None, None) if form == "plain" else (first, second - first)), *sha)

    names = ["n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    return _select(docs, id_col, text_col, make, "n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string", names, seed)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, cut by seed 42."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))

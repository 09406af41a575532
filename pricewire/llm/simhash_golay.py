"""SimHash near-dedup by Golay-code fuzzy hashing.

A text's fingerprint has bit b set if over half of its shingles' XXH64 values have it.  The 64 bits are cut into three
segments of at most 23 bits, each a word of the perfect binary Golay code [23, 12, 7]:

- Decoding a word gives the indices of all codewords within distance 4 of it: one for words at most 2 from a codeword,
  six for the others (3 from theirs).  A word between two words that differ in two bits lies at most 3 from some codeword, which is
  then at most 4 from both: words at most two bits apart share an index, and of words at most one bit apart
  the nearest codeword of one is among the indices of the other.
- Four errors fall on three segments (pigeonhole).  Either a segment is free of errors and another has at most two: key of
  the first's bits and an index of the second (six ordered pairs, "exact" keys).  Or all have errors, then two have one and
  the third at most two, so one of its three parts has none: key of an index of each of the two and a part's bits (nine
  kinds of key), where one fingerprint gives the nearest index of the first and all of the second ("left"), the other
  all of the first and the nearest of the second ("right").
- Fingerprints meet on keys and are verified.  A key's fingerprints are first compared with one of them only, drawn per
  key by a hash (a star, so a group of m near copies gives no m * m pairs); after connected components, only those
  of different components that share a key are compared.  No link between components is left out.

Equal fingerprints are one class from the start, so copies are not expanded.

Defined cases: null or empty text (or no word) has fingerprint zero and links like any other; fewer words than ``k`` are one
shingle; a null doc_id takes part but is a component's id only if all its ids are null; repeated rows are
one class and keep a row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewire.llm.common import saved
from pricewire.llm.graph import connected_components

SEED = 42
MAX_BITS = 4
SEGMENTS = ((42, 22), (21, 21), (0, 21))  # (shift, bits) from the top; each fits a word of 23 bits
GENERATOR = 0b110001110101                # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, of the Golay code
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
PART = 1 << 16  # shingles whose bits are unpacked at a time


def fingerprint(text: str | None, k: int = 4) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    import xxhash
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    if not words:
        return 0
    line = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    width = min(k, len(words))
    begins = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(begins[:len(words) - width + 1].tolist(), ends[width - 1:].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(line[a:b], SEED) for a, b in spans), np.uint64, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), PART):
        part = h[at:at + PART].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, k: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one row per input row, fp as a signed long."""
    @F.pandas_udf("long")
    def fp(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(np.fromiter((fingerprint(t, k) for t in batch), np.uint64, len(batch)).view(np.int64))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), fp(F.col(text_col).cast("string")).alias("fp"))


# -------------------------------------------------------------- the code
def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(check bits of the 4096 codewords; per syndrome the error patterns of weight at most 4, nearest first, -1: none)."""
    check = np.array([_remainder(i << 11) for i in range(4096)], np.int64)
    one = [_remainder(1 << b) for b in range(23)]
    found: list[list[int]] = [[] for _ in range(2048)]
    level = [(0, 0, -1)]  # (pattern, syndrome, highest bit), by weight
    for _ in range(5):
        for pattern, syndrome, _last in level:
            found[syndrome].append(pattern)
        level = [(p | 1 << b, s ^ one[b], b) for p, s, last in level for b in range(last + 1, 23)]
    errors = np.full((2048, max(map(len, found))), -1, np.int64)
    for syndrome, patterns in enumerate(found):
        errors[syndrome, :len(patterns)] = patterns
    return check, errors


def codeword_indices(words: np.ndarray) -> np.ndarray:
    """(n, 6) indices of the codewords within distance 4 of each 23-bit word, nearest first, -1 where there are fewer."""
    check, errors = _tables()
    e = errors[check[words >> 11] ^ (words & 0x7FF)]
    return np.where(e >= 0, (words[:, None] ^ e) >> 11, -1)


EXACT, LEFT, RIGHT = 0, 1, 2  # EXACT keys meet each other, LEFT ones meet RIGHT ones


def _keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, kind) of all keys."""
    u = fps.view(np.uint64)
    segs = [((u >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64) for shift, bits in SEGMENTS]
    codes = [codeword_indices(s) for s in segs]
    rows, keys, kinds = [], [], []

    def add(tag: int, key: np.ndarray, ok: np.ndarray, kind: int) -> None:
        at = np.nonzero(ok)
        rows.append(at[0])
        keys.append((key | (tag << 40))[at])
        kinds.append(np.full(len(at[0]), kind, np.int8))

    for tag, (a, b) in enumerate((a, b) for a in range(3) for b in range(3) if a != b):
        add(tag, (segs[a] << 12)[:, None] | codes[b], codes[b] >= 0, EXACT)
    for c, (_, bits) in enumerate(SEGMENTS):
        a, b = (s for s in range(3) if s != c)
        for j in range(3):
            low, high = bits * j // 3, bits * (j + 1) // 3
            part = ((segs[c] >> low) & ((1 << (high - low)) - 1))[:, None]
            tag = 6 + 3 * c + j
            add(tag, ((codes[a][:, :1] << 12 | codes[b]) << 8) | part, codes[b] >= 0, LEFT)
            add(tag, ((codes[a] << 12 | codes[b][:, :1]) << 8) | part, codes[a] >= 0, RIGHT)
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(kinds)


def _key_rows(classes: DataFrame) -> DataFrame:
    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = batch["fp"].to_numpy(np.int64)
            for at in range(0, len(fps), 2000):
                row, key, kind = _keys(fps[at:at + 2000])
                yield pd.DataFrame({"key": key, "fp": fps[at:at + 2000][row], "kind": kind})
    return classes.select("fp").mapInPandas(emit, "key long, fp long, kind byte")


# ------------------------------------------------------------- the links
def _near(a: str, b: str, max_bits: int):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= max_bits


def fingerprint_links(classes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """classes(fp), distinct -> verified links (u, v) that join every component (not every pair inside one)."""
    # A key is live if two fingerprints can meet on it; XOR with a hash of the key draws the one that the others are held against.
    turn = F.xxhash64("key")
    groups = _key_rows(classes).groupBy("key").agg(
        F.min("fp").alias("low"), F.max("fp").alias("high"), F.max("kind").alias("last"),
        F.min(F.when(F.col("kind") != RIGHT, F.col("fp").bitwiseXOR(turn))).alias("drawn"))
    live = saved(groups.filter((F.col("low") != F.col("high")) & F.col("drawn").isNotNull() & (F.col("last") != LEFT))
                 .select("key", F.col("drawn").bitwiseXOR(turn).alias("rep")))
    # Keys are cheaper made again than carried: only those of live keys go on.
    post = saved(_key_rows(classes).join(live, "key"))
    star = saved(post.filter((F.col("fp") != F.col("rep")) & (F.col("kind") != LEFT) & _near("fp", "rep", max_bits))
                 .select(F.col("rep").alias("u"), F.col("fp").alias("v")).distinct())
    comp = connected_components(star)
    named = (post.join(comp.withColumnRenamed("node", "fp"), "fp", "left")
             .select("key", "fp", "kind", F.coalesce("component", "fp").alias("c")))
    open_ = named.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high").select("key")
    rest = saved(named.join(open_, "key", "left_semi"))
    one = rest.filter(F.col("kind") != RIGHT).select("key", F.col("fp").alias("u"), F.col("c").alias("cu"))
    two = rest.filter(F.col("kind") != LEFT)
    more = one.join(two, (one["key"] == two["key"]) & (F.col("cu") != F.col("c")) & _near("u", "fp", max_bits)
                    & ((F.col("kind") == RIGHT) | (F.col("u") < F.col("fp"))))
    return star.unionByName(more.select("u", F.col("fp").alias("v")).distinct())


def near_duplicates(docs: DataFrame, k: int = 4, max_bits: int = MAX_BITS, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, n_same (rows with its fingerprint)."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("the segments' keys are complete for at most 4 differing bits")
    rows = saved(fingerprints(docs, k, id_col, text_col))
    classes = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n_same")))
    links = saved(fingerprint_links(classes, max_bits))
    comp = connected_components(links).withColumnRenamed("node", "fp")
    named = saved(classes.join(comp, "fp", "left").withColumn("label", F.coalesce("component", "fp")))
    lows = named.filter("component is not null").groupBy("label").agg(F.min("low").alias("least"))
    of_class = named.join(lows, "label", "left").select(
        "fp", "n_same", F.when(F.col("component").isNull(), F.col("low")).otherwise(F.col("least")).alias("component_id"))
    return rows.join(of_class, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_same")

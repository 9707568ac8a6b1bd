"""Sequence packing by minimum bin slack.

Every document becomes token ids plus an end id. Ids are cut into full windows and one tail;
the tails are packed by subset-sum over the *multiset of tail lengths*, which has fewer entries
than a window has tokens however large the corpus is. Only that histogram reaches the driver.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termforge.llm import common

WINDOW = 1024
END_ID = 0
#: Groups that the pieces of one length are dealt over: tails by length, and full windows.
TAIL_SALTS = 64
FULL_SALTS = 16384
#: The vocabulary's pre-tokenisation with possessive quantifiers: the same matches, no backtracking.
PRETOKENS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

# The added tokens of byte_bpe_50k.json, found in a text before it is cut into words.
SPECIAL = {"<|endoftext|>": 50256}

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("doc_tokens", T.LongType(), False),
        T.StructField(
            "pieces",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("start", T.LongType(), False),
                        T.StructField("length", T.LongType(), False),
                        T.StructField("ids_crc32", T.LongType(), False),
                    ]
                ),
                False,
            ),
            False,
        ),
    ]
)


def encoder(ranks_path: str):
    """A byte-level BPE encoder from a file of base64 tokens and ranks."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("bpe", pat_str=PRETOKENS, mergeable_ranks=ranks, special_tokens=SPECIAL)


def default_ranks_path() -> str:
    """Ranks of the same vocabulary as byte_bpe_50k.json; tests hold the ids against that file's."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encode(enc, text: str | None) -> np.ndarray:
    ids = enc.encode_to_numpy(text, allowed_special="all") if text else np.empty(0, np.uint32)
    return np.append(ids.astype("<u4", copy=False), np.uint32(END_ID))


def cut_pieces(docs: DataFrame, window: int = WINDOW, ranks_path: str | None = None) -> DataFrame:
    """doc_id, doc_tokens and the pieces (start, length, crc32 of the ids) of every document.

    A null or empty text has the end id alone. Long texts are cut, never shortened.
    """
    given = ranks_path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(given or default_ranks_path())
        for batch in batches:
            ids_out, tokens, pieces = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(enc, text.as_py())
                ids_out.append(doc_id)
                tokens.append(len(ids))
                pieces.append(
                    [
                        {"start": s, "length": len(part := ids[s : s + window]), "ids_crc32": zlib.crc32(part.tobytes())}
                        for s in range(0, len(ids), window)
                    ]
                )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids_out, pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array(
                        pieces,
                        pa.list_(
                            pa.struct([(n, pa.int64()) for n in ("start", "length", "ids_crc32")])
                        ),
                    ),
                ],
                names=["doc_id", "doc_tokens", "pieces"],
            )

    return common.spread(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(common.trimmed(run), PIECES)


def fullest_subset(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths (within ``counts``) whose sum comes closest to ``room`` from below.

    Bitset subset sum: bit s says that some chosen multiset adds up to s. Multiplicities are split
    into powers of two; the bitset before each item is kept, to find the chosen items backwards.
    """
    mask = (1 << (room + 1)) - 1
    reach, goal, trail = 1, 1 << room, []
    for length in sorted(counts, reverse=True):
        left, k = min(counts[length], room // length if length <= room else 0), 1
        while left > 0 and not reach & goal:
            take = min(k, left)
            trail.append((reach, length, take))
            reach |= (reach << (length * take)) & mask
            left, k = left - take, k * 2
        if reach & goal:
            break
    total, chosen = reach.bit_length() - 1, {}
    for before, length, take in reversed(trail):
        if not (before >> total) & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return chosen


def plan_windows(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """(lengths with multiplicities, repeats) for windows that use up the histogram exactly.

    Each window takes the largest length left and the subset that leaves least slack beside it;
    the same choice is repeated as often as the counts allow, so the number of entries depends on
    the number of distinct lengths and not on the corpus.
    """
    counts = {n: c for n, c in histogram.items() if c > 0}
    plan = []
    while counts:
        top = max(counts)
        rest = {n: c - (n == top) for n, c in counts.items() if c > (n == top)}
        chosen = fullest_subset(rest, window - top)
        chosen[top] = chosen.get(top, 0) + 1
        times = min(counts[n] // k for n, k in chosen.items())
        plan.append((chosen, times))
        for n, k in chosen.items():
            counts[n] -= k * times
            if not counts[n]:
                del counts[n]
    return plan


def slot_table(plan: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, multiplicity, first offset), ordered by length and rank."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for chosen, times in plan:
        offset = 0
        for length in sorted(chosen, reverse=True):
            k = chosen[length]
            rows.append((length, used.get(length, 0), sequence, k, offset))
            used[length] = used.get(length, 0) + k * times
            offset += length * k
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(docs: DataFrame, window: int = WINDOW, ranks_path: str | None = None) -> DataFrame:
    """Pieces of all documents with their places: one row per piece.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. No piece is longer
    than the window and no id is dropped. An empty table gives no rows; null doc_ids are kept.

    Ranks within a length come from counts by (length, salt), so that a length with very many
    pieces (full windows, copies of a document) is dealt over many groups.
    """
    spark = docs.sparkSession
    cut = common.written(cut_pieces(docs, window, ranks_path), "pieces")
    pieces = cut.select("doc_id", "doc_tokens", F.explode("pieces").alias("p")).select("doc_id", "doc_tokens", "p.*")
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.when(F.col("length") == window, FULL_SALTS).otherwise(TAIL_SALTS)).cast("int"))
    groups = pieces.groupBy("length", "salt").agg(F.count("*").alias("n"))
    # at most window * TAIL_SALTS + FULL_SALTS rows, whatever the corpus
    rows = sorted(tuple(r) for r in groups.collect())
    histogram: dict[int, int] = {}
    first: dict[int, np.ndarray] = {}
    for length, salt, n in rows:
        first.setdefault(length, np.zeros(FULL_SALTS if length == window else TAIL_SALTS, np.int64))[salt] = histogram.get(length, 0)
        histogram[length] = histogram.get(length, 0) + n
    slots = slot_table(plan_windows(histogram, window))
    stride = np.int64(1) << np.int64(50)
    keys = slots[:, 0] * stride + slots[:, 1]

    place = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    @F.pandas_udf(place)
    def placed(length, salt, rank):
        import pandas as pd

        size = length.to_numpy(np.int64)
        base = np.array([first[n][s] for n, s in zip(size.tolist(), salt.tolist())], np.int64)
        at = base + rank.to_numpy(np.int64) - 1
        row = slots[np.searchsorted(keys, size * stride + at, side="right") - 1]
        j = at - row[:, 1]
        return pd.DataFrame({"sequence_id": row[:, 2] + j // row[:, 3], "offset": row[:, 4] + j % row[:, 3] * size})

    ranked = pieces.selectExpr("*", "row_number() over (partition by length, salt order by doc_id, start) as rank")
    out = ranked.withColumn("at", placed("length", "salt", "rank"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "at.sequence_id", "at.offset")

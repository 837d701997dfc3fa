"""Token counts by a two-tier lookup on the map side; no pre-token is ever shuffled.

A text is cut into pre-tokens across which the tokenizer can merge nothing.  Tier
one is a broadcast table of the lengths of frequent pre-tokens, at most
``TABLE_SIZE`` entries; tier two a bounded cache in each Python worker, filled by
the tokenizer itself.  Both only save time: every pre-token's length comes from
the tokenizer, so the counts are those of the whole text.

The table is filled from a sample of about ``SAMPLE_ROWS`` documents.  Null text
counts as empty (0 bytes, 0 tokens); other columns are carried along untouched, but for
those named n_bytes and n_tokens, which give way.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.llm.common import texts_of, worker_state

SAMPLE_ROWS = 2_000
TABLE_SIZE = 50_000
CACHE_SIZE = 1_000_000
SPACE = "▁"  # how the vocabulary writes a space
_UNITS = re.compile(rf"\n[^{SPACE}\n]*|{SPACE}+[^{SPACE}\n]*")


def load(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def splittable(sp) -> bool:
    """May texts be cut before each run of spaces and around each line break?

    So if no piece goes on into a space after another character, none longer than
    one character holds a line break, and the text itself is not normalised.
    """
    pieces = (sp.id_to_piece(i) for i in range(sp.vocab_size()))
    if any(SPACE in p.lstrip(SPACE) or ("\n" in p and p != "\n") for p in pieces):
        return False
    kept = [sp.encode(x, out_type=str) for x in ("a  b", "\u00c5 a")]
    return "".join(kept[0]) == f"{SPACE}a{SPACE}{SPACE}b" and kept[1][0] == f"{SPACE}\u00c5" and len(sp.encode("\n")) == 2


def pre_tokens(text: str) -> list[str]:
    """Keys of ``text``: 'x' stands for a space and x; '\\nx' for a line break and x, without a space."""
    if "  " in text or text.startswith(" ") or SPACE in text:
        return [u if u[0] == "\n" else u[1:] for u in _UNITS.findall(SPACE + text.replace(" ", SPACE))]
    return text.replace("\n", " \n").split(" ")


class Lengths(dict):
    """Both tiers: holds the broadcast table, and asks the bounded cache for what is missing."""

    def __init__(self, sp, table: dict[str, int], size: int = CACHE_SIZE):
        super().__init__(table)
        self.encode, self.limit = sp.encode, len(table) + size // 2
        self.table, self.old = table, {}

    def __missing__(self, key: str) -> int:
        if (n := self.old.get(key)) is None:
            n = 1 if not key else len(self.encode(key)) - (key[0] == "\n")
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
            self.update(self.table)
        self[key] = n
        return n


def _frequent(docs: DataFrame, sample_rows: int, size: int) -> list[str]:
    """The most frequent pre-tokens of a sample, ``size`` at most; each task of the scan sends a bounded number of counts."""
    rows = docs.count()
    if not rows:
        return []

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for text in texts_of(b):
                seen.update(pre_tokens(text))
                if len(seen) > 8 * size:
                    seen = Counter(dict(seen.most_common(2 * size)))
        best = seen.most_common(2 * size)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in best], pa.string()), pa.array([n for _, n in best], pa.int64())], names=["unit", "n"])

    sample = docs.select("text").sample(fraction=min(1.0, sample_rows / rows), seed=5)
    found = sample.mapInArrow(tally, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    return [r.unit for r in found.orderBy(F.desc("n"), "unit").limit(size).collect()]


def count_tokens(docs: DataFrame, model: str, sample_rows: int = SAMPLE_ROWS, table_size: int = TABLE_SIZE) -> DataFrame:
    """``docs`` with n_bytes and n_tokens (a null text has 0 of either)."""
    spark = docs.sparkSession
    sp = load(model)
    cut = splittable(sp)
    table = {}
    if cut:
        lengths = Lengths(sp, {})
        table = {k: lengths[k] for k in _frequent(docs, sample_rows, table_size)}
    shared = spark.sparkContext.broadcast(pickle.dumps(table))
    key = uuid.uuid4().hex

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = worker_state(key, lambda: Lengths(load(model), pickle.loads(shared.value)))
        get = lengths.__getitem__
        for b in batches:
            if cut:
                n = [sum(map(get, pre_tokens(x))) if x else 0 for x in texts_of(b)]
            else:
                n = [len(lengths.encode(x)) for x in texts_of(b)]
            at = b.schema.get_field_index("text")
            columns = [c for i, c in enumerate(b.columns) if i != at] + [pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[x for x in b.schema.names if x != "text"] + ["n_tokens"])

    slim = docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    out = [f for f in slim.schema.fields if f.name not in ("text", "n_tokens")]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out) + ", n_tokens bigint"
    return slim.select(*[f"`{f.name}`" for f in out], "text").mapInArrow(count, ddl)

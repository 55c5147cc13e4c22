"""Document blocks: the corpus dealt once into compressed groups, and compact exchanges between them.

Corpus-wide questions about windows, n-grams or byte strings are asked as messages:

* every block sends, for each bucket of a hash space, the fingerprints of its items (``ask``);
* every bucket sees all fingerprints of its share of the hash space and answers with one
  small value for each item, in the order asked (``answer``);
* every block computes its items again, which is cheap and deterministic, and puts the
  answers where they belong (``settle``).

A block holds about BLOCK_BYTES of text and a bucket its share of the fingerprints; both
counts grow with the corpus, so no task's need does. An item costs its fingerprint in the
shuffle, never its text. The dealt blocks are checkpointed with their partitioning, so the
later rounds neither read the source nor shuffle texts again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ensolith.lineage import cut, use_checkpoints  # noqa: F401
from ensolith.llm.textops import SEPARATOR, give_back_memory

BLOCK_BYTES = 8 << 20


def n_blocks(docs: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks for the corpus: at least the session's shuffle partitions, more as the text grows."""
    total = docs.agg(F.sum(F.octet_length(F.col(text))).alias("b")).first()["b"] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // block_bytes))


@dataclass
class Block:
    """The documents of a group, ordered by id and text: their bytes, a separator after each."""

    group: int
    ids: np.ndarray
    has_id: np.ndarray
    has_text: np.ndarray
    bounds: np.ndarray
    buf: np.ndarray
    rest: pa.Table | None = None

    def text(self, d: int) -> bytes:
        return self.buf[self.bounds[d] : self.bounds[d + 1] - 1].tobytes()

    def id_list(self) -> list:
        return [int(i) if ok else None for i, ok in zip(self.ids, self.has_id)]


PIECE = "grp int, ids binary, lens binary, body binary, rest binary"


def _pieces(batches):
    z = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        grp = batch.column("grp").to_numpy(zero_copy_only=False)
        ids, texts = batch.column("id"), batch.column("text")
        order = np.argsort(grp, kind="stable")
        edges = np.flatnonzero(np.diff(grp[order], prepend=-1)) if len(order) else []
        rest = pa.RecordBatch.from_arrays(batch.columns[3:], names=batch.schema.names[3:]) if batch.num_columns > 3 else None
        rows = {k: [] for k in ("grp", "ids", "lens", "body", "rest")}
        for a, b in zip(edges, [*edges[1:], len(order)]):
            take = pa.array(order[a:b])
            t = texts.take(take).cast(pa.large_binary()).to_pylist()
            rows["grp"].append(int(grp[order[a]]))
            i = ids.take(take)
            rows["ids"].append(np.stack([i.fill_null(0).to_numpy(zero_copy_only=False), i.is_valid().to_numpy(zero_copy_only=False)]).astype("<i8").tobytes())
            rows["lens"].append(np.array([-1 if x is None else len(x) for x in t], "<i8").tobytes())
            rows["body"].append(z.compress(b"".join(x or b"" for x in t)))
            rows["rest"].append(z.compress(_written(rest.take(take))) if rest is not None else None)
        yield pa.RecordBatch.from_arrays([pa.array(rows["grp"], pa.int32()), *(pa.array(rows[k], pa.binary()) for k in ("ids", "lens", "body", "rest"))], names=list(rows))
    give_back_memory()


def _written(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def deal(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Rows (id, text, carried columns) dealt into n groups by content, compressed on the way, checkpointed.

    Rows are kept as they are: null ids, null texts and repeated rows stay rows of their own.
    """
    spark = docs.sparkSession
    own, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    pick = docs.select(F.pmod(F.xxhash64(own, text), F.lit(n)).cast("int").alias("grp"), own.alias("id"), text.alias("text"), *(F.col(c).alias(f"c{k}") for k, c in enumerate(carry or [])))
    pieces = pick.mapInArrow(_pieces, PIECE)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the checkpoint forgets how it is partitioned
    try:
        return cut(pieces.repartition(n, "grp"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def block_of(table: pa.Table) -> Block:
    z = zstandard.ZstdDecompressor()
    ids, ok, docs, rest = [], [], [], []
    for i, n, body, more in zip(*(table[c].to_pylist() for c in ("ids", "lens", "body", "rest"))):
        if more is not None:
            rest.append(pa.ipc.open_stream(z.decompress(more)).read_all())
        i, n, raw = np.frombuffer(i, "<i8").reshape(2, -1), np.frombuffer(n, "<i8"), z.decompress(body)
        ends = np.cumsum(np.maximum(n, 0))
        docs += [None if k < 0 else raw[e - k : e] for k, e in zip(n.tolist(), ends.tolist())]
        ids.append(i[0])
        ok.append(i[1] > 0)
    ids, ok = np.concatenate(ids), np.concatenate(ok)
    order = sorted(range(len(docs)), key=lambda k: (not ok[k], ids[k], docs[k] or b""))
    docs = [docs[k] for k in order]
    size = np.array([1 + len(x or b"") for x in docs], np.int64)
    body = bytes([SEPARATOR]).join(x or b"" for x in docs) + bytes([SEPARATOR])
    return Block(table["grp"][0].as_py(), ids[order], ok[order], np.array([x is not None for x in docs]), np.concatenate([[0], np.cumsum(size)]), np.frombuffer(body, np.uint8), pa.concat_tables(rest).take(pa.array(order)) if rest else None)


def _arrow_schema(columns: dict[str, pa.DataType]) -> pa.Schema:
    return pa.schema(list(columns.items()))


MESSAGE = {"bucket": pa.int32(), "grp": pa.int32(), "a": pa.binary(), "b": pa.binary(), "c": pa.binary(), "n": pa.int64()}
MESSAGE_DDL = "bucket int, grp int, a binary, b binary, c binary, n long"


def messages(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[]] * len(MESSAGE)
    return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(columns, MESSAGE.values())], schema=_arrow_schema(MESSAGE))


def _group(fn: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """fn of a group, with the memory it used given back afterwards."""

    def run(t: pa.Table) -> pa.Table:
        try:
            return fn(t)
        finally:
            give_back_memory()

    return run


def _cogroup(fn: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return fn(left, right)
        finally:
            give_back_memory()

    return run


def ask(pieces: DataFrame, fn: Callable[[Block], list[tuple]]) -> DataFrame:
    """One round's messages of every block: fn gives rows (bucket, grp, a, b, c, n)."""
    return pieces.groupBy("grp").applyInArrow(_group(lambda t: messages(fn(block_of(t)))), MESSAGE_DDL)


def answer(asked: DataFrame, fn: Callable[[list[dict]], list[tuple]]) -> DataFrame:
    """Every bucket's answers; fn sees the bucket's messages in order of group and gives rows like them."""
    return asked.groupBy("bucket").applyInArrow(_group(lambda t: messages(fn(sorted(t.to_pylist(), key=lambda r: r["grp"])))), MESSAGE_DDL)


def ask_again(pieces: DataFrame, answers: DataFrame, fn: Callable[[Block, dict], list[tuple]]) -> DataFrame:
    """Messages of every block that depend on answers it got: fn(block, {bucket: answer})."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return messages(fn(block_of(left), {r["bucket"]: r for r in right.to_pylist()}) if left.num_rows else [])

    return pieces.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(_cogroup(run), MESSAGE_DDL)


def settle(pieces: DataFrame, answers: DataFrame, fn: Callable[[Block, dict], pa.Table], ddl) -> DataFrame:
    """The result rows of every block: fn(block, {(c, bucket): answer}); c tells rounds apart."""
    names = _ddl_schema(ddl) if isinstance(ddl, str) else to_arrow_schema(ddl)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return names.empty_table()
        return fn(block_of(left), {(r["c"], r["bucket"]): r for r in right.to_pylist()}).cast(names)

    return pieces.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(_cogroup(run), ddl)


_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary()}


def _ddl_schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, _KINDS[kind]) for name, kind in (part.split() for part in ddl.split(", "))])



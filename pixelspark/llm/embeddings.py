"""Embedding near-dedup: sign hashing by random hyperplanes, exact cosine check, components."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .scratch import Scratch


def hyperplanes(dim: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, bits * tables))


def bits_for(rows: int, per_bucket: int = 64, least: int = 6, most: int = 60) -> int:
    """Bits per table: random vectors then share a bucket of about ``per_bucket`` at any size."""
    return max(least, min(most, math.ceil(math.log2(max(rows, 1) / per_bucket + 1))))


def tables_for(bits: int, cosine: float, recall: float) -> int:
    """Tables needed so that a pair at the threshold meets with probability ``recall``."""
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return max(4, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def packed(values: np.ndarray) -> bytes:
    """A vector in single precision where that is exact, else in double."""
    single = values.astype(np.float32)
    return b"f" + single.tobytes() if (single == values).all() else b"d" + values.tobytes()


def opened(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.float32 if data[:1] == b"f" else np.float64, offset=1).astype(np.float64)


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each usable vector's components, and the vector scaled by a power of two; null for others."""
    for batch in batches:
        column = batch.column("vec")
        size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = column.flatten()
        values = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # -0.0 is 0.0
        ends = np.cumsum(size)
        labelled = batch.column("lab").is_valid().to_numpy(zero_copy_only=False)
        digests, vectors = [], []
        for a, b, known in zip((ends - size).tolist(), ends.tolist(), labelled.tolist(), strict=True):
            v = values[a:b]
            largest = np.abs(v).max() if b > a else 0.0  # NaN if any component is
            if not known or not np.isfinite(largest) or largest == 0:
                digests.append(None)
                vectors.append(None)
            else:
                digests.append(hashlib.sha256(v.tobytes()).digest())
                vectors.append(packed(np.ldexp(v, -int(np.frexp(largest)[1]))))
        yield pa.record_batch([*batch.select(["id", "lab", "r"]).columns, pa.array(digests, pa.binary()), pa.array(vectors, pa.binary())], names=["id", "lab", "r", "dig", "vec"])


def _signatures(bits: int, tables: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            vectors = [opened(v.as_py()) for v in batch.column("vec")]
            dims = np.array([len(v) for v in vectors], np.int32)
            keys = np.zeros((len(vectors), tables), np.int64)
            for dim in np.unique(dims).tolist():
                if dim not in planes:
                    planes[dim] = hyperplanes(dim, bits, tables, seed)
                at = np.flatnonzero(dims == dim)
                signs = (np.stack([vectors[i] for i in at]) @ planes[dim] > 0).reshape(len(at), tables, bits)
                keys[at] = (signs * weights).sum(axis=2)
            yield pa.record_batch([*batch.columns, pa.array(dims), pa.array(list(keys), pa.list_(pa.int64()))], names=[*batch.schema.names, "dim", "keys"])

    return run


def _linked(x: np.ndarray, cosine: float, keys: np.ndarray, table: int, across: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows at ``cosine`` or more, and which of them met in no earlier table.

    ``across`` marks the first of two blocks; only pairs of both are wanted then.
    """
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    close = x @ x.T / (norm[:, None] * norm[None, :]) >= cosine
    i, j = np.nonzero(np.triu(close, 1) if across is None else close & across[:, None] & ~across[None, :])
    fresh = ~(keys[i, :table] == keys[j, :table]).any(axis=1)
    return i, j, fresh


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n rows the first row of its component under the links (i, j)."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


_KEY = ["lab", "dim", "tab", "sig", "low", "high"]
_FOUND = ["a", "rep", "links", "root", "root_rep"]


def _links(cosine: float):
    """Links inside buckets, from rows that are sorted by bucket: their number for each vector, and a root.

    The pairs of a bucket are looked at in one matrix and counted there; no row is made for a pair.
    """

    def found(rows: pa.RecordBatch, starts: list[int]) -> pa.RecordBatch | None:
        cls, members, tab, low, high, own = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("cls", "members", "tab", "low", "high", "own"))
        vectors, keys = rows.column("vec"), rows.column("keys")
        out: list[list[np.ndarray]] = [[], [], []]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if b - a < 2:
                continue
            x = np.stack([opened(v.as_py()) for v in vectors.slice(a, b - a)])
            k = keys.slice(a, b - a).flatten().to_numpy().reshape(b - a, -1)
            i, j, fresh = _linked(x, cosine, k, int(tab[a]), own[a:b] == low[a] if low[a] < high[a] else None)
            if not len(i):
                continue
            m, f, g = members[a:b], i[fresh], j[fresh]
            links = np.bincount(f, m[g], b - a) + np.bincount(g, m[f], b - a)
            root = _roots(b - a, i, j)
            touched = np.union1d(i, j)
            for column, v in zip(out, (touched + a, links[touched].astype(np.int64), root[touched] + a), strict=True):
                column.append(v)
        if not out[0]:
            return None
        at, links, root = (np.concatenate(c) for c in out)
        rep = rows.column("rep")
        return pa.record_batch([pa.array(cls[at]), rep.take(pa.array(at)), pa.array(links), pa.array(cls[root]), rep.take(pa.array(root))], names=_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            change = np.zeros(rows.num_rows, bool)
            for c in _KEY:
                code = rows.column(c).dictionary_encode().indices.to_numpy(zero_copy_only=False)
                change |= np.diff(code, prepend=-1) != 0
            starts = np.flatnonzero(change).tolist()
            made = found(rows, starts)  # the last bucket may go on in the next batch
            if made is not None:
                yield made
            rest = rows.slice(starts[-1])
        if rest is not None:
            made = found(rest, [0, rest.num_rows])
            if made is not None:
                yield made

    return run


def near_duplicates(
    vectors: DataFrame,
    cosine: float = 0.98,
    recall: float = 0.999,
    seed: int = 7,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    block: int = 1024,
    hot: int = 1000,
) -> DataFrame:
    """Links and components of vectors with equal labels and ``cosine`` or more between them.

    Equal vectors of a label form a class first (label and SHA-256 of the components), so a vector repeated many
    times costs one row in the search and its copies count through the class size.  Class
    representatives get one sign key per table; those that share a key of a label are a bucket, and
    are compared exactly in double precision, as one matrix.  A pair counts in the first table in which
    it meets.  Buckets above ``block`` vectors are cut into blocks, and every two blocks are one task's group.
    No row is made for a pair: each vector gets its number of links and, for the components, a root.
    Bits per table grow with the number of classes so buckets keep their size, and tables grow with
    bits so the chance of meeting at the threshold stays ``recall``.

    Returns one row for each input row: id, ``n_links``, ``component_id``, ``kept``.  A null
    label or vector, a zero or empty vector, null or non-finite components, and vectors of another
    length than their label's partner link with nothing: n_links 0, component_id the id itself,
    kept true.  Vectors are scaled by a power of two first, which is exact, so neither huge nor tiny
    finite components overflow or vanish.  Repeated rows count as separate vectors of one id.  A null id gets
    component_id null, or that of its class if it has non-null members, and kept false there.
    Other columns are ignored, whatever their names.  An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("lab"), F.monotonically_increasing_id().alias("r"), F.col(vec_col).cast("array<double>").alias("vec"))
    id_type, lab_type = rows.schema["id"].dataType, rows.schema["lab"].dataType
    schema = T.StructType([*rows.schema.fields[:3], T.StructField("dig", T.BinaryType()), T.StructField("vec", T.BinaryType())])
    rows = scratch.keep(rows.mapInArrow(_prepare, schema))
    n = rows.count()
    classes = rows.where("dig is not null").groupBy("lab", "dig").agg(F.min("r").alias("cls"), F.min("id").alias("rep"), F.count(F.lit(1)).alias("members"))
    classes = scratch.keep(classes)
    bits = bits_for(classes.count())
    tables = tables_for(bits, cosine, recall)
    leads = rows.select("r", "lab", "vec").join(classes.select(F.col("cls").alias("r"), "rep", "members"), "r").withColumnRenamed("r", "cls")
    schema = T.StructType([*leads.schema.fields, T.StructField("dim", T.IntegerType()), T.StructField("keys", T.ArrayType(T.LongType()))])
    signed = scratch.keep(leads.mapInArrow(_signatures(bits, tables, seed), schema))

    bucket = ["lab", "dim", "tab", "sig"]
    large = signed.select("lab", "dim", F.posexplode("keys").alias("tab", "sig")).groupBy(*bucket).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > block)
    large = scratch.keep(large.select(*bucket, F.ceil(F.col("c") / block).cast("int").alias("blocks")), n // block)
    posts = signed.select("cls", "lab", "rep", "members", "vec", "dim", "keys", F.posexplode("keys").alias("tab", "sig")).join(large, bucket, "left")
    posts = posts.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.hash("cls"), "blocks"))
    posts = posts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    posts = posts.select("cls", "lab", "rep", "members", "vec", "dim", "keys", "tab", "sig", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    schema = T.StructType([T.StructField(c, id_type if c.endswith("rep") else T.LongType()) for c in _FOUND])
    found = scratch.keep(posts.repartition(*_KEY).sortWithinPartitions(*_KEY).mapInArrow(_links(cosine), schema))
    scratch.drop(signed)

    # a node sorts by the id it stands for, so the least node of a component has the component's id
    node = lambda cls, rep: F.struct(F.col(rep).isNull().alias("no_id"), F.col(rep).alias("rep"), F.col(cls).alias("cls"))
    comp = connected_components(found.select(node("a", "rep").alias("a"), node("root", "root_rep").alias("b")), scratch)
    comp = comp.select(F.col("node.cls").alias("cls"), F.col("component.rep").alias("component_id"))
    others = found.groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("others"))
    per_class = classes.join(others, "cls", "left").join(comp, "cls", "left").select(
        "lab", "dig", "members",
        (F.col("members") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
        F.coalesce("component_id", "rep").alias("component_id"),
    )
    # rows of a class that holds a share of all rows (at most ``hot`` classes do) are dealt over several keys
    shares = F.broadcast(classes.where(F.col("members") > max(hot, n // hot)).select("lab", "dig", F.lit(True).alias("often")))
    spread = 64
    per_class = per_class.withColumn("salt", F.explode(F.when(F.col("members") > max(hot, n // hot), F.sequence(F.lit(0), F.lit(spread - 1))).otherwise(F.array(F.lit(0))))).drop("members")
    out = rows.select("id", "lab", "dig", "r").join(shares, ["lab", "dig"], "left")
    out = out.withColumn("salt", F.when(F.col("often"), F.pmod(F.hash("r"), F.lit(spread))).otherwise(0)).join(per_class, ["lab", "dig", "salt"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, component.isNull()).alias("kept"),
    )

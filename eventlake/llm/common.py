"""Helpers shared by the training-data operators.

Conventions that hold for every operator of this subpackage:

* Text is processed whole.  A null text counts as the empty text.
* Input columns pass through.  An operator's own output column replaces an
  input column of the same name (compared without case, as Spark resolves
  names), so clashing names never fail.
* Helper columns carry the prefix ``__el_``.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that separate words in the contracts' ``[^\x20\x09-\x0D]+``.  bytes.split() uses the same six.
SPACES = b" \t\n\r\x0b\x0c"
_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
#: bytes.translate table: A-Z to a-z, all else as it is.
FOLD = bytes.maketrans(_UPPER, _LOWER)
#: bytes.translate table: ASCII letters and digits stay (folded), bytes of non-ASCII characters stay, the rest is a space.
FOLD_WORDS = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_ascii(c: Column) -> Column:
    """Lower-case A-Z only.  ASCII strings take the vectorised lower()."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, _UPPER.decode(), _LOWER.decode())
    )


def id_remainder(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def without(df: DataFrame, names: list[str]) -> list[str]:
    """df's columns but those that clash with ``names``."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def ref(name: str) -> Column:
    """A column by its literal name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


#: Bytes of a batch that are worked on at once: a worker holds results of so much input, not of a whole batch.
SLICE_BYTES = 4 << 20


def slices(columns: tuple[pa.Array, ...]) -> Iterator[tuple[pa.Array, ...]]:
    """A batch in parts of about SLICE_BYTES, without copies; an empty batch as it is."""
    rows, size = len(columns[0]), sum(c.nbytes for c in columns)
    step = max(1, rows if size <= SLICE_BYTES else rows * SLICE_BYTES // size)
    for at in range(0, max(rows, 1), step):
        yield tuple(c.slice(at, step) for c in columns)


def arrow_apply(
    df: DataFrame,
    inputs: list[Column],
    schema: T.StructType,
    process: Callable[[Iterator[tuple[pa.Array, ...]]], Iterator[pa.StructArray]],
    keep: bool = True,
) -> DataFrame:
    """Append the fields of ``schema`` that ``process`` makes of ``inputs``, batch by batch.

    One Arrow UDF per task: models are set up once per iterator, other columns
    never leave the JVM, no shuffle.
    """
    from pyspark.sql.functions import arrow_udf

    if len(inputs) == 1:

        def one(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
            yield from process(part for x in it for part in slices((x,)))

        udf = arrow_udf(one, schema)
    else:

        def many(it: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            yield from process(part for x in it for part in slices(x))

        udf = arrow_udf(many, schema)
    names = [f.name for f in schema.fields]
    kept = [ref(c) for c in without(df, names)] if keep else []
    return df.select(*kept, udf(*inputs).alias("__el_out")).select(
        *([ref(c) for c in without(df, names)] if keep else []),
        *[F.col("__el_out").getField(n).alias(n) for n in names],
    )


def struct_array(columns: list, fields: list[tuple[str, pa.DataType]]) -> pa.StructArray:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)]
    return pa.StructArray.from_arrays(arrays, fields=[pa.field(n, t) for n, t in fields])


def text_bytes(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text, null as empty; no whole-column copy."""
    view = column.cast(pa.binary()) if pa.types.is_string(column.type) else column.cast(pa.large_binary())
    for x in view:
        yield x.as_py() or b""


def draw(df: DataFrame, n: int, *more: Column) -> DataFrame:
    """The ``n`` rows of df (unique doc_id) with the least hashes of doc_id, the same at every run; ``more`` breaks ties.

    Rows are counted first, so that only about twice as many as are asked for
    are sorted, however many tasks they come from.
    """
    h, rows = F.xxhash64("doc_id"), df.count()
    if rows > 2 * n:
        df = df.where(h < F.lit(int(-(1 << 63) + (1 << 64) * (2 * n / rows))))
    return df.orderBy(h, "doc_id", *more).limit(n)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where it is unset and the master is local, as in tests, a temporary one that
    goes with the process; on a cluster it is an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that the cluster shares")
        named = tempfile.mkdtemp(prefix="eventlake-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)


def new_path(spark: SparkSession, kind: str) -> str:
    """A name in the shared folder for a table that is written once; what is written there stays until the folder's owner clears it."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{kind}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)

"""Reading and writing by file extension."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framequery.errors import DtError
from framequery.lower import RID, quoted
from framequery.sources.scratch import written

READS = ("csv", "tsv", "json", "jsonl", "ndjson", "parquet", "arrow", "feather", "xlsx", "xls")
WRITES = tuple(x for x in READS if x != "xls")
CHUNK = 100_000


def extension(path: str) -> str | None:
    """The last extension in lower case, below one trailing ``.gz``."""
    name = os.path.basename(str(path).rstrip("/")).removesuffix(".gz")
    stem, dot, ext = name.rpartition(".")
    return ext.lower() if dot and ext else None


def _unsupported(ext: str | None, known: tuple) -> DtError:
    return DtError("unsupported-format", f"{ext or 'no extension'}: supported are {', '.join(known)}", extension=ext, supported=list(known))


def parquet_options(options: dict) -> dict:
    """Options under names with underscores, the column lists as lists of plain names."""
    out = {}
    for k, v in options.items():
        k = str(k).lstrip(":").replace("-", "_")
        out[k] = [str(x).lstrip(":") for x in ([v] if isinstance(v, str) else v)] if k.startswith("column_") and v is not None else v
    return out


def _pruned(df: DataFrame, options: dict) -> DataFrame:
    """Only wanted columns, so that the scan reads no others."""
    options = parquet_options(options)
    allow = options.get("column_allowlist") or options.get("column_whitelist")
    block = options.get("column_blocklist") or options.get("column_blacklist")
    if allow is not None:
        df = df.select(*[quoted(c) for c in df.columns if c in allow])
    if block is not None:
        df = df.select(*[quoted(c) for c in df.columns if c not in block])
    return df


def _pandas_excel(work):
    try:
        return work()
    except ImportError as e:
        raise DtError("missing-dep", f"spreadsheets need an engine for pandas: {e}") from e


def read(spark: SparkSession, path: str, *, separator: str | None = None, schema: Any = None, key_fn: Any = None, **options: Any) -> DataFrame:
    """A file, or a folder of files, of any supported kind; ``.gz`` is read as it is.

    ``column_allowlist`` / ``column_blocklist`` choose columns, ``key_fn`` renames them; with ``schema`` no pass over the
    file is spent on finding types. Arrow and spreadsheet files are read on the driver.
    """
    ext = extension(path)
    if ext not in READS:
        raise _unsupported(ext, READS)
    r = spark.read if schema is None else spark.read.schema(schema)
    if ext in ("csv", "tsv"):
        df = r.csv(path, header=True, inferSchema=schema is None, sep=separator or ("\t" if ext == "tsv" else ","))
    elif ext == "json":
        df = r.json(path, multiLine=True)
    elif ext in ("jsonl", "ndjson"):
        df = r.json(path)
    elif ext == "parquet":
        df = r.parquet(path)
    elif ext in ("arrow", "feather"):
        df = spark.createDataFrame(_arrow_table(path))
    else:
        import pandas as pd

        df = spark.createDataFrame(_pandas_excel(lambda: pd.read_excel(path)))
    df = _pruned(df, options)
    return df.toDF(*[key_fn(c) for c in df.columns]) if key_fn else df


def _arrow_table(path: str):
    """An Arrow stream or file, or a Feather file (which is an Arrow file)."""
    import pyarrow as pa

    with pa.OSFile(path) as f:
        head = f.read(6)
    with pa.OSFile(path) as f:
        return (pa.ipc.open_file(f) if head == b"ARROW1" else pa.ipc.open_stream(f)).read_all()


def _json_lines(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a JSON Lines file, in its order; blank lines are none."""
    schema = read(spark, path).schema
    return spark.read.text(path).filter(F.trim("value") != "").select(F.from_json("value", schema).alias("v")).select("v.*")


def read_seq(spark: SparkSession, path: str, *, batch_size: int = CHUNK, **options: Any) -> Iterator[DataFrame]:
    """The file in pieces: Parquet by row groups, JSON Lines by ``batch_size`` rows, JSON whole. Each piece is a table.

    An action on each piece is a Spark job of its own; ``read_pieces`` gives those of JSON Lines as one table.
    """
    ext = extension(path)
    if ext == "json":
        yield read(spark, path, **options)
        return
    if ext in ("jsonl", "ndjson"):
        size, rows, held = max(1, int(batch_size)), _json_lines(spark, path), []
        schema = rows.schema
        for r in rows.toLocalIterator(prefetchPartitions=True):
            held.append(r)
            if len(held) == size:
                yield _pruned(spark.createDataFrame(held, schema), options)
                held = []
        if held:
            yield _pruned(spark.createDataFrame(held, schema), options)
        return
    if ext != "parquet":
        raise _unsupported(ext, ("parquet", "jsonl", "ndjson", "json"))
    import pyarrow.parquet as pq

    f = pq.ParquetFile(path)
    for i in range(f.num_row_groups):
        yield _pruned(spark.createDataFrame(f.read_row_group(i)), options)


def read_pieces(spark: SparkSession, path: str, *, batch_size: int = CHUNK, piece: str = "piece", **options: Any) -> DataFrame:
    """The pieces that ``read_seq`` makes of a JSON Lines file, together: its rows, with the number of their piece from 0 on.

    However many pieces there are, one job groups by them. The rows are written to the shared folder first, so that
    their numbers are the same whatever is read again.
    """
    ext = extension(path)
    if ext not in ("jsonl", "ndjson"):
        raise _unsupported(ext, ("jsonl", "ndjson"))
    rows = _pruned(_json_lines(spark, path), options)
    if piece in rows.columns:
        raise DtError("duplicate-column", f"the file has a column {piece}", column=piece)
    kept = rows.columns
    rows = written(rows.withColumn(RID, F.monotonically_increasing_id()), "pieces")
    # an id is the partition's number times 2^33 plus the row's place in it; one row a partition tells how many stand before
    rows = rows.withColumn("__part", F.shiftright(RID, 33))
    counts = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__before"))
    place = F.col("__before") + quoted(RID) % (1 << 33)
    number = F.call_function("div", place, F.lit(max(1, int(batch_size))))
    return rows.join(F.broadcast(before), "__part").select(*map(quoted, kept), number.alias(piece))


def write(df: DataFrame, path: str, *, separator: str | None = None, single: bool = True, **options: Any) -> None:
    """One file of that name; ``single=False`` writes a folder of part files instead, in parallel, which is what large
    tables need. Arrow and spreadsheet files are written by the driver."""
    ext = extension(path)
    if ext not in WRITES:
        raise _unsupported(ext, WRITES)
    df = df.drop(RID)
    if ext in ("arrow", "feather"):
        import pyarrow as pa
        from pyarrow import feather

        table = df.toArrow()
        if ext == "feather":
            feather.write_feather(table, path)
        else:
            with pa.OSFile(path, "wb") as sink, pa.ipc.new_stream(sink, table.schema) as w:
                w.write_table(table)
        return
    if ext == "xlsx":
        _pandas_excel(lambda: df.toPandas().to_excel(path, index=False))
        return
    gz = "gzip" if str(path).endswith(".gz") else None
    kind = {"tsv": "csv", "jsonl": "json", "ndjson": "json"}.get(ext, ext)
    opts = {"header": True, "sep": separator or ("\t" if ext == "tsv" else ",")} if kind == "csv" else {}
    if kind == "json":
        opts["ignoreNullFields"] = False
    if gz:
        opts["compression"] = gz
    if not single:
        df.write.mode("overwrite").options(**opts).format(kind).save(path)
        return
    folder = f"{path}.{uuid.uuid4().hex}"
    if ext == "json":  # a JSON document is one array
        lines = df.coalesce(1).select(F.to_json(F.struct(*map(quoted, df.columns)), {"ignoreNullFields": "false"}).alias("value"))
        lines.mapInArrow(_bracketed, "value string").write.options(**({"compression": gz} if gz else {})).text(folder)
    else:
        df.coalesce(1).write.options(**opts).format(kind).save(folder)
    _one_file(df.sparkSession, folder, path, nothing=b"[]" if ext == "json" else None)


def _bracketed(batches):
    """Lines of objects as the lines of one array."""
    import pyarrow as pa

    some = False
    for b in batches:
        lines = b.column(0).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([("," if some or i else "[") + x for i, x in enumerate(lines)], pa.string())], ["value"])
        some = some or bool(lines)
    yield pa.RecordBatch.from_arrays([pa.array(["]" if some else "[]"], pa.string())], ["value"])


def _one_file(spark: SparkSession, folder: str, path: str, nothing: bytes | None) -> None:
    """Give the only part file its name, through the file system that holds it; without one the file holds ``nothing``."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path
    fs = at(folder).getFileSystem(conf)
    part = next((x.getPath() for x in fs.listStatus(at(folder)) if x.getPath().getName().startswith("part-")), None)
    fs.delete(at(path), True)
    if part is None and nothing is not None:
        if path.endswith(".gz"):
            import gzip

            nothing = gzip.compress(nothing)
        out = fs.create(at(path), True)
        out.write(nothing, 0, len(nothing))
        out.close()
    elif part is not None:
        fs.rename(part, at(path))
    fs.delete(at(folder), True)


def from_rows(spark: SparkSession, columns: dict[str, list], schema: str | None = None) -> DataFrame:
    """A small table from columns of values."""
    names = list(columns)
    rows = list(zip(*columns.values(), strict=True))
    return spark.createDataFrame(rows, schema or names)

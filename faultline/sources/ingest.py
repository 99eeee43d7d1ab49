"""Sources and sinks: archives, CSV tables, typed Parquet, summaries, manifests, append-only folders."""

from __future__ import annotations

import json
import time
import uuid
import zipfile
from collections.abc import Iterable, Mapping, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


def unzip(archive: str | Path, target: str | Path, overwrite: bool = False) -> list[Path]:
    """Extracts files that aren't there yet; a name that would leave the target is an error before anything is written."""
    root = Path(target).resolve()
    out = []
    with zipfile.ZipFile(archive) as z:
        names = [i for i in z.infolist() if not i.is_dir()]
        for i in names:
            if not (root / i.filename).resolve().is_relative_to(root):
                raise ValueError(f"{i.filename} leaves {root}")
        for i in names:
            to = root / i.filename
            if overwrite or not to.exists():
                z.extract(i, root)
            out.append(to)
    return out


def all_strings(columns: Sequence[str], key: str = "Id") -> T.StructType:
    """The fixed schema of categorical tables: a long key and strings."""
    return T.StructType([T.StructField(c, T.LongType() if c == key else T.StringType()) for c in columns])


def read_csv_tree(spark: SparkSession, folder: str, schema: T.StructType | str) -> DataFrame:
    """All CSV files below a folder; an error if there is none."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(folder, schema=schema, header=True)
    if not df.inputFiles():
        raise FileNotFoundError(f"no CSV files below {folder}")
    return df


def coerced(rows: DataFrame, types: Mapping[str, str], label: str | None = None) -> DataFrame:
    """rows with columns cast; what can't be cast is null, and a null label is 0."""
    out: dict[str, Column] = {}
    for c, kind in types.items():
        x = F.col(c).try_cast(kind)
        out[c] = F.coalesce(x, F.lit(0).cast(kind)) if c == label else x
    return rows.withColumns(out)


def csv_to_parquet(spark: SparkSession, csv: str, parquet: str, schema: T.StructType | str, *, overwrite: bool = False, first: int | None = None, order: str | None = None) -> tuple[int, str]:
    """(rows, action): generated, or skipped where the target is there. `first` rows need an `order`, without which they would be any."""
    if first is not None and not order:
        raise ValueError("the first rows of what order?")
    if exists(spark, parquet) and not overwrite:
        return spark.read.parquet(parquet).count(), "skipped"
    df = spark.read.csv(csv, schema=schema, header=True)
    if first is not None:
        df = df.orderBy(order).limit(first)
    df.write.mode("overwrite").parquet(parquet)
    return spark.read.parquet(parquet).count(), "generated"


def file_status(action: Column, sample: Column, rows: Column, known_sample_rows: Column) -> Column:
    """How far a file can be trusted: generated in full or as a sample; skipped files count as samples only if their row count is on record."""
    return F.when(action == "generated", F.when(sample, "generated_sample").otherwise("generated_full")).when(known_sample_rows == rows, "sampled").otherwise("unverified")


def overall_status(statuses: DataFrame, column: str = "status", *by: str) -> DataFrame:
    """One status of many: mixed, unknown, full_data or sample."""
    full = F.max((F.col(column) == "generated_full").cast("int")) == 1
    part = F.max(F.col(column).isin("generated_sample", "sampled").cast("int")) == 1
    doubt = F.max((F.col(column) == "unverified").cast("int")) == 1
    return statuses.groupBy(*by).agg(F.when(full & part, "mixed").when(doubt, "unknown").when(full, "full_data").when(part, "sample").otherwise("unknown").alias("overall"))


def upsert_summary(path: str | Path, key: str, entry: Mapping) -> dict:
    """Sets one key of a small JSON file, by a new file that replaces the old one."""
    p = Path(path)
    held = json.loads(p.read_text()) if p.exists() else {}
    held[key] = dict(entry)
    p.parent.mkdir(parents=True, exist_ok=True)
    new = p.with_name(p.name + ".new")
    new.write_text(json.dumps(held, indent=2, sort_keys=True, allow_nan=False))
    new.replace(p)
    return held


#: Statuses of files that are known to be samples.
SAMPLES = ("generated_sample", "sampled")


def sample_evidence(path: str | Path) -> dict[str, int]:
    """Files that a former manifest calls samples, with their rows. Claims of full data are never carried on; without a readable manifest there is no evidence."""
    try:
        told = json.loads(Path(path).read_text())
    except (OSError, ValueError):
        return {}
    files = told.get("files") if isinstance(told, dict) else None
    if isinstance(files, dict):
        return {n: f["rows"] for n, f in files.items() if isinstance(f, dict) and f.get("full_data_status") in SAMPLES and isinstance(f.get("rows"), int)}
    if isinstance(told, dict) and told.get("is_full_data") is False and isinstance(told.get("row_counts"), dict):  # an older form
        return {n: k for n, k in told["row_counts"].items() if isinstance(k, int)}
    return {}


def write_manifest(spark: SparkSession, path: str | Path, files: Mapping[str, tuple[int, str]], sample_rows: int | None = None, tag: str | None = None) -> dict:
    """Writes and returns what is known of each file (rows, action) and of all together, by the statuses above and the former manifest."""
    known = sample_evidence(path)
    rows = [(n, k, a, sample_rows is not None, known.get(n)) for n, (k, a) in files.items()]
    t = spark.createDataFrame(rows, "name string, rows long, action string, sample boolean, known long")
    t = t.withColumn("status", file_status(F.col("action"), F.col("sample"), F.col("rows"), F.col("known")))
    overall = overall_status(t).first().overall
    held = {"requested_sample_rows": sample_rows, "sample_tag": tag, "status": overall, "is_full_data": {"full_data": True, "sample": False}.get(overall), "files": {r.name: {"rows": r.rows, "action": r.action, "full_data_status": r.status} for r in t.collect()}}
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    new = p.with_name(p.name + ".new")
    new.write_text(json.dumps(held, indent=2, sort_keys=True))
    new.replace(p)
    return held


def append_locked(rows: DataFrame, path: str) -> None:
    """Appends rows to a Parquet table in its own columns, order and types; other columns, or values that can't be cast, are an error."""
    spark = rows.sparkSession
    if exists(spark, path):
        schema = spark.read.parquet(path).schema
        if sorted(schema.names) != sorted(rows.columns):
            raise ValueError(f"columns {sorted(rows.columns)} aren't those of the table, {sorted(schema.names)}")
        lost = rows.agg(*[F.count_if(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull()).alias(f.name) for f in schema]).first().asDict()
        if bad := {k: n for k, n in lost.items() if n}:
            raise ValueError(f"values that don't fit the table's types: {bad}")
        rows = rows.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema])
    rows.write.mode("append").parquet(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Appends rows to a log of CSV files, none of which is read or written again."""
    rows.write.mode("append").csv(path, header=True)


def load_all(spark: SparkSession, paths: Mapping[str, str], schema: T.StructType | str) -> dict[str, DataFrame]:
    """All the named CSV tables; an error that lists the missing ones if any is."""
    missing = [n for n, p in paths.items() if not exists(spark, p)]
    if missing:
        raise FileNotFoundError(f"missing tables: {missing}")
    return {n: spark.read.csv(p, schema=schema, header=True) for n, p in paths.items()}


#: Fixed value: how the files of committed production batches are named below their base.
BATCH_KEY = r"^predictions/cycle=[0-9]+/batch=[0-9]+/predictions\.parquet$"


def batch_keys(keys: DataFrame, column: str = "key") -> DataFrame:
    """The keys that name production batches, sorted."""
    return keys.where(F.col(column).rlike(BATCH_KEY)).orderBy(column)


def write_submission(rows: DataFrame, path: str, key: str = "Id", label: str = "Response") -> None:
    """CSV of key and label in the order of the key."""
    rows.select(key, label).orderBy(key).write.mode("errorifexists").csv(path, header=True)


def put_new(spark: SparkSession, path: str, data: bytes) -> None:
    """Writes a file that must not be there yet; FileExistsError if it is. Of writers that race for a path one succeeds.

    The file system decides, by creating without overwriting, which a name node or an object
    store with conditional writes does in one step; so does the operating system for local paths.
    Errors of the store are raised, never taken for a missing file.
    """
    fs, p = _hadoop(spark, path)
    if not fs.exists(p.getParent()):
        fs.mkdirs(p.getParent())
    if p.toUri().getScheme() in (None, "file") and fs.getScheme() == "file":  # Hadoop's local file system looks, then creates
        with open(p.toUri().getPath(), "xb") as f:
            f.write(data)
        return
    try:
        out = fs.create(p, False)
    except Exception as e:
        if fs.exists(p):
            raise FileExistsError(path) from e
        raise
    try:
        out.write(data)
    finally:
        out.close()


def upload_new(spark: SparkSession, source: str, target: str) -> None:
    """Copies a local file to a path that must not be there yet, of any store; FileExistsError if it is."""
    put_new(spark, target, Path(source).read_bytes())


def _move_in(spark: SparkSession, staged: str, path: str) -> None:
    """Renames a folder that was written in full to its final name, in one step. Whoever finds it unmoved may do it."""
    fs, to = _hadoop(spark, path)
    if exists(spark, f"{path}/_SUCCESS"):
        return
    if fs.exists(to):  # no writer makes this folder but by the rename below; what is there without a mark is of an older form
        fs.delete(to, True)
    fs.mkdirs(to.getParent())
    try:
        fs.rename(_hadoop(spark, staged)[1], to)
    except Exception:
        if not exists(spark, f"{path}/_SUCCESS"):  # someone else has moved it meanwhile, or it is a fault
            raise
    if not exists(spark, f"{path}/_SUCCESS"):
        raise OSError(f"{staged} couldn't be moved to {path}")


def write_partition(rows: DataFrame, base: str, parts: Mapping[str, int], *, must_be_new: bool = False) -> bool:
    """Writes rows to base/key=value/... unless that partition was committed before; True if it was written.

    Rows are staged under a hidden name first. The claim is a small file, made without
    overwriting, that names the staged folder: of writers that race for a partition one makes it, the others
    delete what they have staged. The staged folder is then renamed. A claim whose rename a lost driver
    has not come to is carried out by whoever meets it next, so a claimed partition is never lost
    or written twice. With `must_be_new`, a partition that another writer has is a FileExistsError.
    """
    spark, base = rows.sparkSession, base.rstrip("/")
    name = "/".join(f"{k}={v}" for k, v in parts.items())
    path, claim = f"{base}/{name}", f"{base}/.claims/{name.replace('/', ',')}"

    def taken() -> bool:
        if exists(spark, claim):
            winner = spark.read.text(claim, wholetext=True).first()[0]
            if exists(spark, winner):
                _move_in(spark, winner, path)
        if exists(spark, f"{path}/_SUCCESS") and must_be_new:
            raise FileExistsError(path)
        return exists(spark, f"{path}/_SUCCESS")

    if taken():
        return False
    staged = f"{base}/.staged-{uuid.uuid4().hex}"
    rows.write.parquet(staged)
    try:
        put_new(spark, claim, staged.encode())
    except FileExistsError:
        fs, mine = _hadoop(spark, staged)
        fs.delete(mine, True)
        for _ in range(100):  # the winner, or this writer for it, moves its folder in
            if taken():
                return False
            time.sleep(0.1)
        raise OSError(f"{claim} names rows that aren't there; delete it to write {path} again") from None
    _move_in(spark, staged, path)
    return True


def read_partitions(spark: SparkSession, base: str, label: Iterable[str] = ("Response", "response"), order: str = "run_seq") -> DataFrame:
    """All committed partitions with their keys as columns, in the order of `order` if there is such a column; labels are refused.

    Folders of a partition without _SUCCESS are what a lost driver has left, and aren't read.
    """
    from faultline.operators.joins import refuse

    fs, root = _hadoop(spark, base)
    done, left = [], [root]
    while left:
        here = left.pop()
        found = fs.listStatus(here)
        below = [f.getPath() for f in found if f.isDirectory() and "=" in f.getPath().getName()]
        if not below and any(f.getPath().getName() == "_SUCCESS" for f in found):
            done.append(here.toString())
        left += below
    if not done:
        raise FileNotFoundError(f"no committed partition below {base}")
    got = refuse(spark.read.option("basePath", base).parquet(*sorted(done)), *label)
    return got.orderBy(order) if order in got.columns else got


def save_lookup(lookup: Mapping[str, DataFrame], path: str, overall: float, fingerprint: str) -> None:
    """Tables of a lookup as Parquet, with overall rate and fingerprint beside them."""
    for name, df in lookup.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(lookup.values())).sparkSession
    spark.createDataFrame([(overall, fingerprint)], "overall double, fingerprint string").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def load_lookup(spark: SparkSession, path: str, fingerprint: str | None = None, names: Sequence[str] = ("station", "transition", "pair", "path")) -> tuple[dict[str, DataFrame], float]:
    """(tables, overall rate); an error if the fingerprint isn't the one given or a table is missing."""
    missing = [n for n in names if not exists(spark, f"{path}/{n}")]
    if missing:
        raise ValueError(f"lookup lacks {missing}")
    meta = spark.read.schema("overall double, fingerprint string").json(f"{path}/meta").first()
    if fingerprint is not None and meta.fingerprint != fingerprint:
        raise ValueError(f"lookup was made from other data: {meta.fingerprint}, not {fingerprint}")
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}, meta.overall


def fingerprint(rows: DataFrame, features: Sequence[str], key: str = "id", label: str = "response") -> str:
    """16 hex digits that depend on the features' names, the set of keys, the row count and the label's sum, not on the order of rows."""
    n, keys, y = rows.agg(F.count("*"), F.sum(F.xxhash64(key).cast("decimal(38,0)")), F.sum(label)).first()
    text = json.dumps([sorted(features), n, str(keys), y and int(y)])
    return rows.sparkSession.range(1).select(F.sha2(F.lit(text), 256)).first()[0][:16]

"""Continuous twins of the batch jobs: intake, quota admission and request roll-up."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.media import payload_gate, sniff_content_type
from ..operators.admission import ADMITTED, quota_admission
from ..operators.assets import asset_kind, expires_at
from ..operators.requests import request_rollup
from ..settings import (
    ADMISSIONS,
    DEFAULT_MAX_IMAGE_BYTES,
    DEFAULT_MAX_IMAGE_PIXELS,
    DEFAULT_QUOTA_BYTES,
    DEFAULT_QUOTA_COUNT,
    DEFAULT_TTL_SECONDS,
)
from ..sources.folders import literal
from ..sources.images import BINARY_FILE, plain_path

FILES_PER_TRIGGER = 10_000
#: Folders whose streams run at a time; a micro-batch of small files leaves most of a cluster idle.
STREAMS = 8
#: Options of their sessions: with a task for every core, starting tasks takes most of a micro-batch of a few hundred small files.
_INTAKE = {
    "spark.sql.files.minPartitionNum": "1",
    "spark.sql.sources.parallelPartitionDiscovery.threshold": "512",
    # Nothing asks for the listing of a micro-batch again.
    "spark.sql.hive.filesourcePartitionFileCacheSize": "0",
}


def stream_images(
    spark: SparkSession,
    folder: str,
    max_bytes: int = DEFAULT_MAX_IMAGE_BYTES,
    files_per_trigger: int = FILES_PER_TRIGGER,
) -> DataFrame:
    """New files of an upload folder; contents above the limit are dropped before they travel.

    Every micro-batch looks through all files of the stream, and its log names them all again and again. Many files lie in folders
    of a few thousand, which ``intake_folders`` takes in one by one.
    """
    content = F.when(F.col("length") <= max_bytes, F.col("content"))
    return (
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILE)
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_per_trigger)
        .load(folder)
        .select(
            plain_path(F.col("path")).alias("path"),
            F.col("length").alias("byte_count"),
            content.alias("content"),
        )
    )


def gated_intake(
    uploads: DataFrame,
    max_bytes: int = DEFAULT_MAX_IMAGE_BYTES,
    max_pixels: int = DEFAULT_MAX_IMAGE_PIXELS,
) -> DataFrame:
    """Uploads with sniffed content type and the code of the first broken rule."""
    content = F.col("content")
    code = F.when(F.col("byte_count") == 0, "invalid_input").when(
        F.col("byte_count") > max_bytes, "payload_too_large"
    )
    return uploads.withColumn("content_type", sniff_content_type(content)).withColumn(
        "error_code", F.coalesce(code, payload_gate(content, max_bytes, max_pixels))
    )


def start_intake(
    gated: DataFrame, target: str, checkpoint: str, once: bool = True, part: str | None = None
) -> StreamingQuery:
    """Write good uploads to ``target/accepted`` and the others to ``target/quarantine``.

    Every micro-batch owns the folder of its number, so a replay replaces what it wrote before. Streams that share a target
    have a ``part`` of it each. The checkpoint tells which micro-batches are complete, their folders hold no marker.
    """
    own = "" if part is None else f"/part={part}"

    def put(rows: DataFrame, path: str) -> None:
        rows.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", False).parquet(path)

    def write(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            put(held.where("error_code IS NULL").drop("error_code"), f"{target}/accepted{own}/batch={number}")
            put(held.where("error_code IS NOT NULL").drop("content"), f"{target}/quarantine{own}/batch={number}")
        finally:
            held.unpersist()

    writer = gated.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _folders(spark: SparkSession, root: str) -> list[str]:
    """Names of the folders in ``root``; what begins with a dot or an underline is no data, any file beside them an error."""
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)
    seen = [(f.getPath().getName(), f.isDirectory()) for f in found]
    seen = [(name, folder) for name, folder in seen if name[:1] not in (".", "_")]
    loose = [name for name, folder in seen if not folder]
    if loose:
        raise ValueError(f"{len(loose)} files of {root} lie in no folder, such as {loose[0]}")
    return sorted(name for name, _ in seen)


def _intake_session(spark: SparkSession) -> SparkSession:
    """A session with the options of another, in which a micro-batch of small files is one task, and few files are listed without a job.

    Scans of larger files are still cut by their bytes. The streams are known to this session alone.
    """
    own = spark.newSession()
    usual = own.conf.getAll
    for key, value in spark.conf.getAll.items():
        if usual.get(key) != value and own.conf.isModifiable(key):
            own.conf.set(key, value)
    for key, value in _INTAKE.items():
        own.conf.set(key, value)
    return own


def intake_folders(
    spark: SparkSession,
    root: str,
    target: str,
    checkpoint: str,
    max_bytes: int = DEFAULT_MAX_IMAGE_BYTES,
    files_per_trigger: int = FILES_PER_TRIGGER,
    streams: int = STREAMS,
) -> None:
    """Take in what has arrived in the folders of ``root``, each as a stream of its own with its own checkpoint, ``streams`` at a time.

    What a micro-batch costs then depends on its folder, not on all files that ever arrived. A later run takes in new files and new
    folders.
    """

    own = _intake_session(spark)

    def take(name: str) -> None:
        part = quote(name, safe="")
        files = stream_images(own, f"{root}/{literal(name)}", max_bytes, files_per_trigger)
        start_intake(gated_intake(files, max_bytes), target, f"{checkpoint}/{part}", part=part).awaitTermination()

    with ThreadPoolExecutor(streams) as pool:
        list(pool.map(take, _folders(spark, root)))


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


_HELD = "principal string, kind string, byte_count long, expires_at timestamp"


class AdmissionLedger:
    """Quota admission of a stream, with tables as its state.

    Micro-batch ``n`` is decided by the batch operator against the assets that are live after batch ``n - 1``, and writes its decisions
    to ``decisions/batch=n`` and what is live now to ``live/batch=n``. Both folders are replaced when a batch runs again, and what a
    batch reads is older than itself, so a replay gives the same decisions. Nothing is grouped by owner: an owner's uploads
    are a stream of rows in one task, as in the batch operator, and its state is rows of a table.

    Snapshots older than the last two are deleted. Assets that expired before the newest upload seen are left out of a snapshot:
    uploads that arrive later with an older time do not meet them. ``held`` is what the store has before the stream begins.
    """

    def __init__(
        self,
        path: str,
        ttl_seconds: int = DEFAULT_TTL_SECONDS,
        quota_bytes: int = DEFAULT_QUOTA_BYTES,
        quota_count: int = DEFAULT_QUOTA_COUNT,
        max_bytes: int = DEFAULT_MAX_IMAGE_BYTES,
        scope: str = "principal",
        held: DataFrame | None = None,
    ):
        self.path, self.scope, self.held = path.rstrip("/"), scope, held
        self.rules = (ttl_seconds, quota_bytes, quota_count, max_bytes)

    def _live(self, spark: SparkSession, number: int) -> DataFrame:
        """What is live after a batch; the store's own stock after none."""
        if number >= 0 and _exists(spark, f"{self.path}/live/batch={number}"):
            return spark.read.schema(_HELD).parquet(f"{self.path}/live/batch={number}")
        if self.held is None:
            return spark.createDataFrame([], _HELD)
        return self.held.select("principal", "kind", F.col("byte_count").cast("long"), "expires_at")

    def decide(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = self._live(spark, number - 1)
        uploads = batch.select("asset_id", "principal", "kind", "content_type", "byte_count", "created_at")
        owner = ["principal"] if self.scope == "principal" else ["principal", "kind"]
        # Only owners that upload in this batch bring their stock to it.
        stock = before.join(uploads.select(*owner).distinct(), owner, "left_semi")
        decided = quota_admission(uploads, *self.rules, scope=self.scope, held=stock)
        target = f"{self.path}/decisions/batch={number}"
        decided.write.mode("overwrite").parquet(target)
        decided = spark.read.schema(decided.schema).parquet(target)
        admitted = decided.where(F.col("decision") == ADMITTED).select(
            "principal",
            asset_kind(F.col("asset_id")).alias("kind"),
            "byte_count",
            expires_at(F.col("created_at"), self.rules[0]).alias("expires_at"),
        )
        newest = uploads.agg(F.max("created_at").alias("t")).first()["t"]
        live = before.unionByName(admitted)
        if newest is not None:
            live = live.where(F.coalesce(F.col("expires_at") > F.lit(newest), F.lit(True)))
        live.write.mode("overwrite").parquet(f"{self.path}/live/batch={number}")
        _delete(spark, f"{self.path}/live/batch={number - 2}")

    def start(self, uploads: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
        writer = uploads.writeStream.foreachBatch(self.decide).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()

    def decisions(self, spark: SparkSession) -> DataFrame:
        rows = spark.read.schema(ADMISSIONS).parquet(f"{self.path}/decisions")
        return rows.select(*ADMISSIONS.fieldNames())


def stream_rollup(
    requests: DataFrame, window: str = "1 hour", delay: str = "1 hour"
) -> DataFrame:
    """The batch roll-up over a stream: in append mode a window is written, and its state dropped, once the
    watermark, ``delay`` behind the last request, passes its end."""
    return request_rollup(requests.withWatermark("ts", delay), window)


def start_table(
    rows: DataFrame, path: str, checkpoint: str, mode: str = "append", once: bool = True
) -> StreamingQuery:
    """A stream into a parquet folder; ``complete`` results replace it with every micro-batch."""
    if mode == "append":
        writer = rows.writeStream.format("parquet").option("path", path)
    else:
        writer = rows.writeStream.foreachBatch(
            lambda batch, number: batch.write.mode("overwrite").parquet(path)
        )
    writer = writer.outputMode(mode).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


"""Files that arrive in a directory, appended to a collection micro-batch by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

from tomolake.operators import frames
from tomolake.operators.volumeset import MANIFEST, VolumeSet
from tomolake.sources import ingest
from tomolake.storage import Store


def append_arrivals(spark: SparkSession, directory: str, uri: str, name: str, checkpoint: str, pattern: str = "*.nii.gz", subject_id: Callable = ingest.default_subject_id, once: bool = True, max_files: int = 10_000):
    """A streaming query: new files become volumes of the collection at ``uri``, at most ``max_files`` a batch (their paths pass the driver).

    The file source's log gives each file to one batch; a batch that runs again after
    a failure skips the paths its collection holds already.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).load(directory).select("path")

    def take(batch, _):
        paths = sorted(r.path.removeprefix("file://").removeprefix("file:") for r in batch.select("path").collect())
        if Store(spark).exists(f"{uri}/{MANIFEST}"):
            here = VolumeSet(spark, uri)
            known = {r[0] for r in frames.of_values(here.root_obs, "source_path", paths).select("source_path").collect()}
            pairs = [(p, subject_id(p)) for p in paths if p not in known]
            if pairs:
                here.append(niftis=pairs)
        elif paths:
            ingest.build_collection(spark, uri, [(p, subject_id(p)) for p in paths], name, "nifti")

    w = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()

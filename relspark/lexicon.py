"""The lexicon: concepts, senses, typed relations, as a bundle of DataFrames."""

from __future__ import annotations

import threading
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Score of concepts that no path connects.
UNRELATED = -1_000_000.0
#: Id of the virtual root that joins all taxonomies of a part of speech.
ROOT = 0


@dataclass(frozen=True)
class Lexicon:
    """synset (pos, id, gloss, examples, words), sense (word, pos, sense, id, word_no), edge (rel,
    src_pos, src, dst_pos, dst, src_word, dst_word; the words are null for relations of whole
    concepts). height: edges on the longest way up, if known; it saves a look for more at each step."""

    synset: DataFrame
    sense: DataFrame
    edge: DataFrame
    height: int | None = None
    taxonomy: DataFrame | None = None

    @property
    def isa(self) -> DataFrame:
        """(pos, child, parent) of the taxonomy; written already if the lexicon brings it. A concept is not its own parent."""
        if self.taxonomy is not None:
            return self.taxonomy
        return self.edge.where("rel = 'hype' and src_pos = dst_pos and src <> dst").select(
            F.col("src_pos").alias("pos"), F.col("src").alias("child"), F.col("dst").alias("parent")
        )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, where lineage is cut. On one machine a session
    without one gets its own beside the warehouse; a cluster must name it."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/../checkpoints"


class Folders(threading.local):
    """Those that a thread has written and nothing has deleted yet, oldest first. Queries that run
    side by side are of different threads, so none deletes what another reads."""

    def __init__(self) -> None:
        self.paths: list[str] = []


_written = Folders()


def new_folder(spark: SparkSession) -> str:
    """A folder that does not exist yet, for a table or for files; `release_since` knows of it."""
    path = f"{shared_dir(spark)}/relspark-{uuid.uuid4().hex}"
    _written.paths.append(path)
    return path


def delete_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    name = path.rsplit("/", 1)[1]
    _written.paths[:] = [p for p in _written.paths if p.rsplit("/", 1)[1] != name]


def delete(df: DataFrame) -> None:
    """Deletes the files of a materialized table that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete_folder(df.sparkSession, folder)


def materialize(df: DataFrame) -> DataFrame:
    """Written once to the shared folder and read back: cuts the lineage, survives the loss of
    executors, and all readers see the same rows. `release_since` deletes what is no longer read."""
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """A mark for release_since."""
    return len(_written.paths)


def release_since(spark: SparkSession, mark: int = 0, but: tuple[DataFrame, ...] = ()) -> None:
    """Deletes the folders that this thread has written since the mark, except those of the tables `but`. For
    callers who have read (or written elsewhere) every result that was made from them."""
    keep = {f.rsplit("/", 1)[0].rsplit("/", 1)[1] for df in but for f in df.inputFiles()}
    for path in [p for p in _written.paths[mark:] if p.rsplit("/", 1)[1] not in keep]:
        delete_folder(spark, path)

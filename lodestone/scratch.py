"""Written tables that cut lineage.

They lie in the shared folder that the cluster names in ``spark.checkpoint.dir``, so that they outlive a lost
executor. Only a local session without that setting gets a folder of its own.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession


#: Folders of local sessions that name none, by application.
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in local mode where the setting is missing."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="lodestone-")
    return _own[app]


class Scratch:
    """The intermediate tables of one run of an operator.

    ``write`` returns the written table; ``drop`` deletes it once nothing will read it any more. What a returned
    DataFrame still reads lazily stays until the Python process ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._folder = self._fs(self.root)  # still usable once the session has stopped
        atexit.register(self.clear)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        df.write.options(**options).mode("overwrite").parquet(self.path(name))
        return self.read(df, name)

    def read(self, like: DataFrame, name: str) -> DataFrame:
        """The table as written, with a known schema: no job is needed to infer it."""
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def files(self, name: str) -> list[str]:
        """The data files of a table, for tasks that read them themselves; as many as the tasks that wrote it."""
        fs, path = self._fs(self.path(name))
        return sorted(x.getPath().toString() for x in fs.listStatus(path) if x.getPath().getName().endswith(".parquet"))

    def drop(self, *names: str) -> None:
        for name in names:
            fs, path = self._fs(self.path(name))
            fs.delete(path, True)

    def clear(self) -> None:
        with suppress(Exception):
            fs, path = self._folder
            fs.delete(path, True)

    def _fs(self, at: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(at)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

"""The state of all relations in a folder: config, files, extents and blocks, changed together or not at all.

Each commit writes the relations that change to new folders and then, by one rename, a manifest that names the folders of
all relations. Readers follow the newest manifest; what a lost or failed commit left behind is never read, and clean()
deletes it. So a commit is all or nothing on any store whose renames are atomic, and unchanged relations are not copied.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "config": "keyname string, keyval string",
    "files": "fileid long, filename string, ino long, subvol string, size long, mtime long, dedupe_seq int, digest string, flags int",
    "extents": "fileid long, loff long, len long, poff long, digest string",
    "blocks": "fileid long, loff long, digest string",
}
#: What a state must have been made with to be used again; else it is made anew, empty.
EXPECTED = {"hash_type": "md5", "version_major": "4"}


class Store:
    """Opens the state in a folder and makes an empty one where there is none, or where it was made with another digest or major version."""

    def __init__(self, spark: SparkSession, path: str, expected: dict[str, str] | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        self._fs = self._at(".").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at("."))
        want = EXPECTED if expected is None else expected
        if self.version() == 0 or any(self.config().get(k) != v for k, v in want.items()):
            rows = [*want.items(), ("version_minor", "1"), ("dedupe_sequence", "0")]
            empty = {name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()}
            self.commit(empty | {"config": spark.createDataFrame(rows, SCHEMAS["config"])})

    def _names(self) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._at("."))]

    def version(self) -> int:
        """The newest committed version; 0 if there is none."""
        return max((int(n[9:-5]) for n in self._names() if n.startswith("manifest-") and n.endswith(".json")), default=0)

    def _manifest(self, version: int) -> dict[str, str]:
        text = self.spark.read.text(f"{self.path}/manifest-{version}.json", wholetext=True).first()[0]
        return json.loads(text)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{self._manifest(self.version())[name]}")

    def config(self) -> dict[str, str]:
        return {r["keyname"]: r["keyval"] for r in self.read("config").collect()}  # a handful of keys

    def commit(self, changed: dict[str, DataFrame]) -> int:
        """The new version's number, once the given relations are written; another commit meanwhile is an error, and nothing is changed."""
        old = self.version()
        names = dict(self._manifest(old)) if old else {}
        for name, df in changed.items():
            names[name] = f"{name}-{uuid.uuid4().hex}"
            df.select(*[f"{c.split()[0]}" for c in SCHEMAS[name].split(", ")]).write.parquet(f"{self.path}/{names[name]}")
        draft = self._at(f"draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        out.writeBytes(json.dumps(names))
        out.close()
        if self._fs.exists(self._at(f"manifest-{old + 1}.json")) or not self._fs.rename(draft, self._at(f"manifest-{old + 1}.json")):
            raise RuntimeError("the state was changed by another commit")
        return old + 1

    def clean(self) -> None:
        """Delete everything that the newest version does not name."""
        now = self.version()
        keep = {f"manifest-{now}.json", *self._manifest(now).values()}
        for name in self._names():
            if name not in keep and not name.startswith("."):
                self._fs.delete(self._at(name), True)

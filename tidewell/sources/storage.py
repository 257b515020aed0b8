"""Named byte objects under a folder of any file system that Spark can reach, through its own file-system classes."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Store:
    """Objects below ``root`` by relative name: a local folder, or any URI whose file system is configured."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm = spark.sparkContext._jvm
        self._root = self._jvm.org.apache.hadoop.fs.Path(root)
        self._gateway, self._conf = spark.sparkContext._gateway, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._root.getFileSystem(self._conf)

    def _path(self, name: str):
        if not name or name.startswith("/") or ".." in name.split("/"):
            raise ValueError(f"no name below the folder: {name!r}")
        return self._jvm.org.apache.hadoop.fs.Path(self._root, name)

    def put(self, name: str, parts) -> None:
        """Write ``parts`` (bytes, or an iterable of bytes) under ``name``: whole or not at all.

        Bytes go to a temporary name in the same folder, which is then renamed over what was there in one step, so that
        what was there stays until then.
        """
        target = self._path(name)
        hidden = self._jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.tmp")
        out = self._fs.create(hidden, True)
        try:
            for part in (parts,) if isinstance(parts, bytes) else parts:
                out.write(bytearray(part))
        except BaseException:
            out.close()
            self._fs.delete(hidden, False)
            raise
        out.close()
        fs = self._jvm.org.apache.hadoop.fs
        options = self._gateway.new_array(getattr(fs, "Options$Rename"), 1)
        options[0] = getattr(fs, "Options$Rename").OVERWRITE
        where = self._fs.makeQualified(target)
        fs.FileContext.getFileContext(where.toUri(), self._conf).rename(self._fs.makeQualified(hidden), where, options)

    def get(self, name: str) -> bytes:
        if not self.exists(name):
            raise FileNotFoundError(name)
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def delete(self, name: str) -> bool:
        return self._fs.delete(self._path(name), False)

    def names(self) -> list[str]:
        """Names of all objects, in order; temporary ones are left out."""
        if not self._fs.exists(self._root):
            return []
        base, found = self._fs.makeQualified(self._root).toString().rstrip("/") + "/", []
        listed = self._fs.listFiles(self._root, True)
        while listed.hasNext():
            path = listed.next().getPath()
            if not path.getName().startswith("."):
                found.append(path.toString()[len(base) :] if path.toString().startswith(base) else path.toUri().getPath()[len(path.getPathWithoutSchemeAndAuthority(self._root).toString()) + 1 :])
        return sorted(found)

"""The dense binary surface-mesh format: three native size_t extents, then doubles, last index fastest.

Read through Spark's ``binaryFile`` source, so any store Spark reads will do. Files are small (a
rank's surface patch); one file is one task's row.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

_NAME = re.compile(r"([zw])_(\d+)_([pf])_r(\d+)\.(\d+)\.view$")


def file_name(rank: int, comm_size: int, mesh_size: int, periodic: bool, x: str) -> str:
    return f"{x}_{mesh_size}_{'p' if periodic else 'f'}_r{rank}.{comm_size}.view"


def parse_name(path: str) -> dict:
    m = _NAME.search(path)
    if not m:
        raise ValueError(f"{path} is not named like a view file")
    return {"x": m[1], "mesh_size": int(m[2]), "periodic": m[3] == "p", "rank": int(m[4]), "comm_size": int(m[5])}


def encode(values) -> bytes:
    """A (d0, d1, d2) array as file bytes."""
    import numpy as np

    a = np.ascontiguousarray(values, dtype=np.float64)
    if a.ndim != 3:
        raise ValueError("a view has three extents")
    return np.asarray(a.shape, dtype=np.uint64).tobytes() + a.tobytes()


def decode(data: bytes, components: int):
    import numpy as np

    if len(data) < 24:
        raise ValueError("a view file has at least its three extents")
    d0, d1, d2 = (int(v) for v in np.frombuffer(data, np.uint64, 3))
    if d2 != components:
        raise ValueError(f"expected {components} components, found {d2}")
    if len(data) != 24 + 8 * d0 * d1 * d2:
        raise ValueError("the file's length does not match its extents")
    return np.frombuffer(data, np.float64, offset=24).reshape(d0, d1, d2)


def read_view(spark: SparkSession, path: str, components: int, names: tuple[str, ...] | None = None) -> DataFrame:
    """(rank, i, j, components...) of every matching file; a missing path or a wrong extent raises."""
    names = names or tuple(f"c{n}" for n in range(components))

    def parse(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for p, data in zip(pdf["path"], pdf["content"]):
                a = decode(bytes(data), components)
                i, j = np.meshgrid(np.arange(a.shape[0]), np.arange(a.shape[1]), indexing="ij")
                yield pd.DataFrame({"rank": parse_name(p)["rank"], "i": i.ravel(), "j": j.ravel(), **{n: a[:, :, c].ravel() for c, n in enumerate(names)}})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.view").load(path).select("path", "content")
    return files.mapInPandas(parse, "rank int, i int, j int, " + ", ".join(f"{n} double" for n in names))


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    return read_view(spark, path, 3, ("x", "y", "z"))


def read_vorticity(spark: SparkSession, path: str) -> DataFrame:
    return read_view(spark, path, 2, ("w0", "w1"))


class ViewSink(DataSource):
    """Write-only source "cellforge_view": rows (name, content) become files of a folder, on the executors.

    A task writes under names of its own; the files get theirs when the job commits, so a task that is
    lost or repeated leaves nothing behind.
    """

    @classmethod
    def name(cls) -> str:
        return "cellforge_view"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _ViewWriter(self.options["path"])


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _ViewWriter(DataSourceWriter):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder)

    def write(self, iterator) -> _Written:
        store, base = self._store()
        store.create_dir(base, recursive=True)
        files = []
        for row in iterator:
            files.append((f"{base}/_{uuid.uuid4().hex}", f"{base}/{row['name']}"))
            with store.open_output_stream(files[-1][0]) as out:
                out.write(bytes(row["content"]))
        return _Written(files)

    def commit(self, messages) -> None:
        store, _ = self._store()
        for m in messages:
            for held, name in m.files if m else ():
                store.move(held, name)

    def abort(self, messages) -> None:
        store, _ = self._store()
        for m in messages:
            for held, _ in m.files if m else ():
                store.delete_file(held)


def write_view(df: DataFrame, folder: str, mesh_size: int, periodic: bool, comm_size: int, names: tuple[str, ...]) -> None:
    """One file for each rank; three components are named z, two w. Encoded and written by the executors."""
    x = "w" if len(names) == 2 else "z"

    def pack(key, pdf):
        import numpy as np
        import pandas as pd

        d0, d1 = int(pdf["i"].max()) + 1, int(pdf["j"].max()) + 1
        if len(pdf) != d0 * d1:
            raise ValueError(f"rank {key[0]} is not a dense surface")
        a = np.zeros((d0, d1, len(names)))
        a[pdf["i"], pdf["j"]] = pdf[list(names)].to_numpy()
        return pd.DataFrame({"name": [file_name(int(key[0]), comm_size, mesh_size, periodic, x)], "content": [encode(a)]})

    df.sparkSession.dataSource.register(ViewSink)
    packed = df.groupBy("rank").applyInPandas(pack, "name string, content binary")
    packed.write.format(ViewSink.name()).mode("append").option("path", folder).save()


def view_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, x, mesh_size, periodic, rank, comm_size) of every view file, from the names alone."""
    name = F.element_at(F.split(F.col("path"), "/"), -1)
    part = lambda n: F.regexp_extract(name, _NAME.pattern, n)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.view").load(path)
    return files.select(name.alias("name"), part(1).alias("x"), part(2).cast("int").alias("mesh_size"), (part(3) == "p").alias("periodic"), part(4).cast("int").alias("rank"), part(5).cast("int").alias("comm_size"))


def surface_particles(z: DataFrame, w: DataFrame, ni: int, nj: int, ghost: int = 2) -> DataFrame:
    """Joins positions and vorticity on (rank, i, j), strips the ghosts and numbers the owned nodes."""
    owned = F.col("i").between(ghost, ghost + ni - 1) & F.col("j").between(ghost, ghost + nj - 1)
    pid = (F.col("i") - ghost) * nj + (F.col("j") - ghost)
    return z.where(owned).join(w.where(owned), ["rank", "i", "j"]).withColumn("pid", pid)


def view_lines(df: DataFrame, names: tuple[str, ...], origins: dict[int, tuple[int, int]] | None = None, at: tuple[int, int] | None = None) -> DataFrame:
    """(rank, i, j, line): what a debug print of a surface shows, "R<rank> <global i> <global j> <i> <j> <components>".

    ``origins`` has each rank's global index of its local (0, 0); with ``at`` only that global node is
    shown. Show it with ``.orderBy("rank", "i", "j").show(n, False)``: ordered and bounded.
    """
    origins = origins or {}
    shift = lambda d: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for r, o in origins.items() for x in (r, o[d])]), F.col("rank")), F.lit(0)) if origins else F.lit(0)
    d = df.withColumns({"_gi": F.col("i") + shift(0), "_gj": F.col("j") + shift(1)})
    if at:
        d = d.where((F.col("_gi") == at[0]) & (F.col("_gj") == at[1]))
    line = F.format_string("R%d %d %d %d %d" + " %.12f" * len(names), "rank", "_gi", "_gj", "i", "j", *names)
    return d.select("rank", "i", "j", line.alias("line"))

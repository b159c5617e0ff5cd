"""A store of layers, each a folder of tables: discovery, guarded reading, queries over all layers, orphans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from . import io


class Store:
    """layers: a folder for each name. Tables of all layers are views of their names, so a query may join any of them."""

    def __init__(self, spark: SparkSession, layers: dict[str, str]) -> None:
        self.spark, self.layers = spark, {n: p.rstrip("/") for n, p in layers.items()}

    def path(self, layer: str, name: str) -> str:
        return f"{self.layers[layer]}/{name}"

    def tables(self, layer: str) -> list[str]:
        """The names of the layer's tables, in order; of a layer without a folder none."""
        folder, fs = io._path(self.spark, self.layers[layer])
        if not fs.exists(folder):
            return []
        names = {s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory()}
        whole = {n.removesuffix(".old") for n in names if n.endswith(".old")} | {n for n in names if not n.endswith((".next", ".old"))}
        return sorted(n for n in whole if not n.startswith(("_", ".")) and io.exists(self.spark, self.path(layer, n)))

    def read(self, layer: str, name: str) -> DataFrame | None:
        """The table, or None where there is none."""
        return self.spark.read.parquet(self.path(layer, name)) if io.exists(self.spark, self.path(layer, name)) else None

    def find(self, name: str) -> DataFrame | None:
        """The table of the first layer that has it."""
        return next((df for layer in self.layers if (df := self.read(layer, name)) is not None), None)

    def query(self, text: str, args: Sequence | None = None) -> DataFrame:
        """Spark SQL over the tables of all layers; ? are the arguments in order. Of a name in two layers the first layer's counts."""
        views = {}
        for layer in self.layers:
            for n in self.tables(layer):
                views.setdefault(n, layer)
        for n, layer in views.items():
            if n in text:
                self.read(layer, n).createOrReplaceTempView(n)
        return self.spark.sql(text, args=list(args)) if args is not None else self.spark.sql(text)

    def drop_orphans(self, layer: str, known: Sequence[str], prefix: str = "", keep: Sequence[str] = ()) -> list[str]:
        """Deletes the layer's tables with the prefix that aren't known or kept, and says which."""
        gone = [n for n in self.tables(layer) if n.startswith(prefix) and n not in known and n not in keep]
        for n in gone:
            path, fs = io._path(self.spark, self.path(layer, n))
            fs.delete(path, True)
        return gone

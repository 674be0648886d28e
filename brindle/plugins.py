"""Ranked index plugins: how a strategy builds, searches and keeps its index, and a registry of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from importlib.metadata import entry_points

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.analyzer import analyzer
from brindle.operators.text import B, K1, TextIndex
from brindle.operators.vector import IVFIndex, graph_top_k

API_VERSION = 1
_VECTOR_OPTIONS = ("metric", "dimension", "profile")
GROUP = "brindle.index_plugins"


class PluginError(ValueError):
    """A plugin that is unknown or badly configured."""


@dataclass(frozen=True)
class Capabilities:
    query_kind: str  # "text" or "vector"
    exact: bool = False
    exhaustive: bool = False
    approximate: bool = False
    mutable: bool = False
    options: tuple[str, ...] = ()  # of CREATE INDEX and USING, beside the defaults


@dataclass
class Plugin:
    """A ranked strategy. One that can be searched overrides ``build`` and ``search``.

    An index is any object; what ``search`` gives are rows (key, score), higher is better.
    ``save`` and ``load`` are for indexes that outlive a session; ``insert`` and
    ``remove`` for mutable ones, both may be repeated with the same rows.
    """

    name: str
    capabilities: Capabilities
    defaults: dict = field(default_factory=dict)
    serves: str = ""  # the type of index that the strategy reads; its own name if empty

    @property
    def index_type(self) -> str:
        return (self.serves or self.name).upper()

    def configure(self, options: dict) -> dict:
        unknown = set(options) - set(self.defaults)
        if unknown:
            raise PluginError(f"{self.name} has no option {sorted(unknown)}")
        return self.defaults | options

    def validate(self, options: dict) -> None:
        unknown = set(options) - set(self.defaults) - set(self.capabilities.options)
        if unknown:
            raise PluginError(f"an index of type {self.name} has no option {sorted(unknown)}")

    def _lacks(self, what: str) -> PluginError:
        return PluginError(f"{self.name} has no {what}")

    def build(self, rows: DataFrame, key: str, column: str, options: dict):
        raise self._lacks("build")

    def search(self, index, query, k: int | None, options: dict) -> DataFrame:
        raise self._lacks("search")

    def save(self, index, folder: str):
        raise self._lacks("save")

    def load(self, spark: SparkSession, folder: str, key: str, options: dict):
        raise self._lacks("load")

    def insert(self, index, rows: DataFrame, key: str, column: str):
        raise self._lacks("insert")

    def remove(self, index, keys: DataFrame, key: str):
        raise self._lacks("remove")

    def drop(self, index) -> None:
        """Free what an index holds; nothing unless overridden."""


class TextPlugin(Plugin):
    """Postings with BM25 or TF-IDF cosine; ``method`` of USING goes before that of the index."""

    def __init__(self, name: str, tokens: Callable[[], Callable[[Column], Column]], method: str | None = None) -> None:
        super().__init__(name, Capabilities("text", exact=True, exhaustive=True, mutable=True), {"method": "bm25", "k1": K1, "b": B}, "INVERTED")
        self.tokens, self.method = tokens, method

    def build(self, rows, key, column, options):
        return TextIndex.build(rows, key, column, self.tokens())

    def search(self, index, query, k, options):
        method = str(options.get("asked_method") or self.method or options.get("method", "bm25")).lower()
        tuned = {o: float(options[o]) for o in ("k1", "b") if o in options and method == "bm25"}
        return index.match_top_k(query, k, method, **tuned) if k else index.scores(query, method, **tuned)

    def save(self, index, folder):
        return index.save(folder)

    def load(self, spark, folder, key, options):
        return TextIndex.open(spark, folder, key, self.tokens())

    def insert(self, index, rows, key, column):
        return index.insert(rows, column)

    def remove(self, index, keys, key):
        return index.remove(keys, key)


class ListsPlugin(Plugin):
    """Inverted lists of vectors."""

    def __init__(self) -> None:
        super().__init__("IVF", Capabilities("vector", approximate=True, mutable=True, options=_VECTOR_OPTIONS), {"nlist": 4, "nprobe": "", "profiles": ""})

    def build(self, rows, key, column, options):
        return IVFIndex.build(rows, key, column, nlist=int(options.get("nlist") or 4))

    def search(self, index, query, k, options):
        nprobe = options.get("nprobe")
        return index.top_k(query, k or 10, str(options["metric"]).lower(), int(nprobe) if nprobe else None)

    def save(self, index, folder):
        return index.save(folder)

    def load(self, spark, folder, key, options):
        return IVFIndex.open(spark, folder, key)

    def insert(self, index, rows, key, column):
        return index.remove(rows, key).insert(rows, key, column)

    def remove(self, index, keys, key):
        return index.remove(keys, key)


class GraphPlugin(Plugin):
    """The contract of a graph index, met by an exact scan."""

    def __init__(self) -> None:
        super().__init__("HNSW", Capabilities("vector", exact=True, exhaustive=True, mutable=True, options=_VECTOR_OPTIONS), {"profiles": ""})

    def build(self, rows, key, column, options):
        return rows.select(F.col(key).alias("key"), F.col(column).alias("vector"))

    def search(self, index, query, k, options):
        return graph_top_k(index, query, k or 10, "key", "vector", str(options["metric"]).lower())

    def save(self, index, folder):
        index.write.parquet(folder)
        return index.sparkSession.read.parquet(folder)

    def load(self, spark, folder, key, options):
        return spark.read.parquet(folder)

    def insert(self, index, rows, key, column):
        return self.remove(index, rows, key).unionByName(self.build(rows, key, column, {}))

    def remove(self, index, keys, key):
        return index.join(keys.select(F.col(key).alias("key")).distinct(), "key", "left_anti")


class PluginRegistry:
    def __init__(self, tokens: Callable[[Column], Column] | None = None) -> None:
        self.plugins: dict[str, Plugin] = {}
        self._tokens = tokens

    @classmethod
    def standard(cls, tokens: Callable[[Column], Column] | None = None) -> PluginRegistry:
        made = cls(tokens)
        words = lambda: made.tokens
        for plugin in (TextPlugin("INVERTED", words), TextPlugin("BM25", words, "bm25"), TextPlugin("TF_IDF", words, "tf_idf"), ListsPlugin(), GraphPlugin()):
            made.register(plugin)
        return made

    @property
    def tokens(self) -> Callable[[Column], Column]:
        if self._tokens is None:
            self._tokens = analyzer()
        return self._tokens

    def __contains__(self, name: str) -> bool:
        return name.upper() in self.plugins

    def register(self, plugin: Plugin) -> None:
        if plugin.name.upper() in self.plugins:
            raise PluginError(f"plugin {plugin.name} is registered")
        self.plugins[plugin.name.upper()] = plugin

    def unregister(self, name: str) -> None:
        self.get(name)
        del self.plugins[name.upper()]

    def get(self, name: str) -> Plugin:
        if name.upper() not in self.plugins:
            raise PluginError(f"no plugin {name}")
        return self.plugins[name.upper()]

    def discover(self) -> int:
        """Register plugins that installed packages announce; returns how many were new."""
        new = [e.load()() for e in entry_points(group=GROUP) if e.name.upper() not in self.plugins]
        for plugin in new:
            self.register(plugin)
        return len(new)

    def configure(self, name: str, options: dict) -> dict:
        return self.get(name).configure(options)

    def kind(self, name: str) -> str:
        return self.get(name).capabilities.query_kind

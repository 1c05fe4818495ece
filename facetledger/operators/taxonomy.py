"""Taxonomy tables, nearest nodes, pruned subtrees and beam walks.

Calls are the large side. A node table whose vectors take at most ``TABLE_BYTES`` goes to every task, and calls are scored
in Arrow batches against it without a shuffle. A larger table is scored by a grid: parts of the distinct call vectors meet
blocks of the nodes, a bounded number of either in a task, and the best hits of the blocks are merged. Either way a call
is walked inside its row, on its own pruned subtree.

Results are the same either way: products are added up component by component, in order, for every hit that is told (a
matrix product only chooses them, with a margin above its rounding). A call without a vector, or with a null in it or of
another width than the nodes', has no hits and an empty subtree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetledger.operators.classify import user_messages, verdict
from facetledger.vocab import LABEL_SUFFIXES, LEVEL_THRESHOLDS

TABLE_BYTES = 64 << 20
GRID_ROWS = 20_000
NODES = "id string, parent_id string, label string, description string, ord int"
HITS = "array<struct<id:string,similarity:double>>"
SUBTREE = "array<struct<parent_id:string,id:string,score:double,ord:int>>"
BEAM = "struct<neg:double,path:array<string>,confidences:array<double>>"


# --- node tables ---


def nodes_from_mapping(spark: SparkSession, root: dict) -> DataFrame:
    """A nested mapping (name -> description, children) as a node table. The mapping is one small file's content."""
    rows: list[tuple] = []
    level = [(None, name, body, i) for i, (name, body) in enumerate(root.items())]
    while level:
        below = []
        for parent, name, body, order in level:
            body = {} if body is None else body
            if not isinstance(name, str) or not name or "/" in name:
                raise ValueError(f"bad node name {name!r}")
            if not isinstance(body, dict):
                raise ValueError(f"node {name!r} must be a mapping")
            if {"child", "desc", "nodes"} & set(body):
                raise ValueError(f"node {name!r} has a misspelt key")
            description, children = body.get("description", ""), body.get("children") or {}
            if not isinstance(description, str) or not isinstance(children, dict):
                raise ValueError(f"node {name!r} has a bad description or children")
            node_id = name if parent is None else f"{parent}/{name}"
            rows.append((node_id, parent, name, description, order))
            below += [(node_id, child, value, i) for i, (child, value) in enumerate(children.items())]
        level = below
    return spark.createDataFrame(rows, NODES)


def node_problems(nodes: DataFrame) -> DataFrame:
    """Faults of a node table: duplicate ids, names with a slash or empty, parents that do not exist."""
    counted = nodes.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    duplicates = counted.select("id", F.lit("duplicate-id").alias("problem"))
    names = nodes.filter((F.coalesce("label", F.lit("")) == "") | F.contains("label", F.lit("/"))).select(
        "id", F.lit("bad-label").alias("problem")
    )
    parents = nodes.select(F.col("id").alias("parent_id")).distinct()
    orphans = nodes.filter("parent_id is not null").join(parents, "parent_id", "left_anti").select(
        "id", F.lit("missing-parent").alias("problem")
    )
    return duplicates.unionByName(names).unionByName(orphans)


def leaves(nodes: DataFrame) -> DataFrame:
    """Nodes that are nobody's parent."""
    parents = nodes.select(F.col("parent_id").alias("id")).filter("id is not null").distinct()
    return nodes.join(parents, "id", "left_anti")


def with_paths(nodes: DataFrame) -> DataFrame:
    """Each node's root-to-node ``path`` and ``depth`` (a root has depth 1), by recursion over parents."""
    paths = nodes.sparkSession.sql(
        """
        WITH RECURSIVE walk AS (
          SELECT id, array(id) AS path FROM {nodes} WHERE parent_id IS NULL
          UNION ALL
          SELECT n.id, concat(w.path, array(n.id)) FROM walk w JOIN {nodes} n ON n.parent_id = w.id
        ) SELECT id, path, size(path) AS depth FROM walk
        """,
        nodes=nodes,
    )
    return nodes.join(paths, "id")


def node_text() -> Column:
    """The text a node is embedded by: label and description, else the label, else the id."""
    described = F.trim(F.coalesce("description", F.lit("")))
    return F.when(described != "", F.concat_ws(": ", "label", described)).otherwise(
        F.coalesce(F.nullif(F.col("label"), F.lit("")), F.col("id"))
    )


def unknown_seeds(nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """Seed ids (column ``node_id``) that are not nodes."""
    return seeds.join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_anti")


def prune(nodes: DataFrame, seeds: DataFrame, query: str) -> DataFrame:
    """Per query, its seed nodes and all their ancestors: one row per kept node."""
    paths = with_paths(nodes).select(F.col("id").alias("node_id"), "path")
    kept = seeds.join(paths, "node_id").select(query, F.explode("path").alias("id")).distinct()
    return kept.join(nodes, "id")


def subtree_children(subtree: DataFrame, query: str) -> DataFrame:
    """Children of each kept node that are kept too, in declared order; the roots are under a null parent."""
    listed = F.array_sort(F.collect_list(F.struct("ord", "id")))
    return subtree.groupBy(query, "parent_id").agg(F.transform(listed, lambda c: c["id"]).alias("children"))


# --- vectors ---


def embed(rows: DataFrame, text: Column, embedder: Callable[[list[str]], np.ndarray], column: str = "embedding") -> DataFrame:
    """Adds a vector column from any batch embedder; each Arrow batch is one call of it."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(np.asarray(embedder(batch.tolist()), dtype=np.float32)))

    return rows.withColumn(column, run(text))


def hash_embedder(dim: int = 16) -> Callable[[list[str]], np.ndarray]:
    """Unit vectors seeded by the text's digest: the same text always gives the same vector."""
    import hashlib

    def vectors(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for i, text in enumerate(texts):
            seed = int.from_bytes(hashlib.sha256(text.encode("utf-8")).digest()[:4], "big")
            drawn = np.random.default_rng(seed).standard_normal(dim).astype(np.float32)
            out[i] = drawn / (float(np.linalg.norm(drawn)) or 1.0)
        return out

    return vectors


def _fits(nodes: DataFrame) -> bool:
    """Whether the vectors of a node table are small enough for every task."""
    rows, width = nodes.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    return rows * (width * 8 + 200) <= TABLE_BYTES


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.float64) for v in vectors])


MARGIN = 1e-9  # far above the rounding of a product of unit vectors


def _exact(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Products of rows with rows, added up one component after the other."""
    total = np.zeros(len(left))
    for k in range(left.shape[1]):
        total += left[:, k] * right[:, k]
    return total


def _scorable(vectors: pd.Series, width: int) -> np.ndarray:
    """Which vectors have a number for each component of the nodes."""
    return np.array([v is not None and len(v) == width and not any(x is None or x != x for x in v) for v in vectors], bool)


def _best_nodes(queries: np.ndarray, matrix: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the indexes and similarities of its k nearest nodes, ties to the smaller index."""
    similarities = queries @ matrix.T
    k = min(k, similarities.shape[1])
    least = np.partition(similarities, similarities.shape[1] - k, axis=1)[:, -k] - MARGIN
    row, node = np.nonzero(similarities >= least[:, None])
    value = _exact(queries[row], matrix[node])
    order = np.lexsort((node, -value, row))
    first = np.searchsorted(row[order], np.arange(len(queries)))
    return [(node[order[a : a + k]], value[order[a : a + k]]) for a in first.tolist()]


def _nearest(ids: list[str], matrix: np.ndarray, vectors: pd.Series, k: int) -> pd.Series:
    hits: list[list] = [[] for _ in range(len(vectors))]
    good = np.flatnonzero(_scorable(vectors, matrix.shape[1]))
    if len(good):
        for i, (nodes, values) in zip(good.tolist(), _best_nodes(_matrix(vectors.iloc[good]), matrix, k)):
            hits[i] = [{"id": ids[j], "similarity": float(v)} for j, v in zip(nodes, values)]
    return pd.Series(hits, dtype=object)


def _grid_hits(vectors: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """``_q`` and its ``_hits``: parts of the vectors against blocks of the nodes, then the best of all blocks."""
    parts, blocks = (max(1, -(-rows.count() // GRID_ROWS)) for rows in (vectors, nodes))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.withColumn("_part", F.pmod(F.xxhash64("_q"), F.lit(parts)).cast("int")).withColumn("_block", every(blocks))
    right = nodes.select("id", "vector", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("_block")).withColumn("_part", every(parts))

    def score(queries: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or table.empty:
            return pd.DataFrame({"_q": [], "_hits": []})
        table = table.sort_values("id")
        return pd.DataFrame({"_q": queries["_q"], "_hits": _nearest(table["id"].tolist(), _matrix(table["vector"]), queries["_q"].reset_index(drop=True), k).to_numpy()})

    kind = vectors.schema["_q"].dataType.simpleString()
    met = left.groupBy("_part", "_block").cogroup(right.groupBy("_part", "_block")).applyInPandas(score, f"_q {kind}, _hits {HITS}")
    best = Window.partitionBy("_q").orderBy(F.desc("h.similarity"), "h.id")
    ranked = met.select("_q", F.explode("_hits").alias("h")).withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= k)
    listed = ranked.groupBy("_q").agg(F.array_sort(F.collect_list(F.struct("_rank", "h"))).alias("_list"))
    return listed.select("_q", F.transform("_list", lambda x: x["h"]).cast(HITS).alias("_hits"))


def top_k(queries: DataFrame, nodes: DataFrame, k: int = 20, vector: str = "embedding", column: str = "hits") -> DataFrame:
    """Exact k nearest nodes of each query by cosine (unit vectors), most similar first, ties by id."""
    if k <= 0 or nodes.isEmpty():
        return queries.withColumn(column, F.array().cast(HITS))
    if not _fits(nodes):
        found = _grid_hits(queries.select(F.col(vector).alias("_q")).filter("_q is not null").distinct(), nodes, k)
        hits = F.coalesce("_hits", F.array().cast(HITS))
        return queries.join(found, F.col(vector) == F.col("_q"), "left").withColumn(column, hits).drop("_q", "_hits")
    table = nodes.select("id", "vector").toPandas().sort_values("id")
    shared = queries.sparkSession.sparkContext.broadcast((table["id"].tolist(), _matrix(table["vector"])))

    @F.pandas_udf(HITS)
    def score(vectors: pd.Series) -> pd.Series:
        return _nearest(*shared.value, vectors, k)

    return queries.withColumn(column, score(F.col(vector)))


def _joined_subtree(queries: DataFrame, nodes: DataFrame, k: int, vector: str) -> DataFrame:
    """The subtree of each distinct vector by joins: nearest nodes, their ancestors, the products with their vectors."""
    distinct = queries.select(F.col(vector).alias("_q")).filter("_q is not null").distinct()
    seeds = _grid_hits(distinct, nodes, k).select("_q", F.explode("_hits").alias("h")).select("_q", F.col("h.id").alias("node_id"))
    kept = prune(nodes.select("id", "parent_id", "ord", "vector"), seeds, "_q")
    product = F.aggregate(F.zip_with("_q", "vector", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    scored = kept.select("_q", "id", "parent_id", "ord", F.least(F.lit(1.0), F.greatest(F.lit(0.0), product)).alias("score"))
    listed = scored.groupBy("_q").agg(F.array_sort(F.collect_list(F.struct("id", "parent_id", "score", "ord"))).alias("_list"))
    subtree = F.transform("_list", lambda n: F.struct(n["parent_id"].alias("parent_id"), n["id"].alias("id"), n["score"].alias("score"), n["ord"].cast("int").alias("ord")))
    return queries.join(listed, F.col(vector) == F.col("_q"), "left").withColumn("subtree", F.coalesce(subtree, F.array().cast(SUBTREE))).drop("_q", "_list")


def with_subtree(queries: DataFrame, nodes: DataFrame, k: int = 20, vector: str = "embedding") -> DataFrame:
    """Adds ``subtree``: the k nearest nodes and their ancestors, each with its similarity clamped to [0, 1]."""
    if not _fits(nodes):
        return _joined_subtree(queries, nodes, k, vector)
    table = with_paths(nodes).select("id", "parent_id", "ord", "path", "vector").toPandas().sort_values("id").reset_index(drop=True)
    position = {node: i for i, node in enumerate(table["id"])}
    paths = [[position[a] for a in path] for path in table["path"]]
    meta = [(p, i, int(o)) for p, i, o in zip(table["parent_id"], table["id"], table["ord"])]
    shared = queries.sparkSession.sparkContext.broadcast((meta, paths, _matrix(table["vector"])))

    @F.pandas_udf(SUBTREE)
    def score(vectors: pd.Series) -> pd.Series:
        meta, paths, matrix = shared.value
        out: list[list] = [[] for _ in range(len(vectors))]
        good = np.flatnonzero(_scorable(vectors, matrix.shape[1]))
        queries = _matrix(vectors.iloc[good])
        for i, query, (best, _) in zip(good.tolist(), queries, _best_nodes(queries, matrix, k) if len(good) else []):
            kept = sorted({a for j in best for a in paths[j]})
            scores = _exact(np.broadcast_to(query, (len(kept), len(query))), matrix[kept])
            out[i] = [{"parent_id": meta[j][0], "id": meta[j][1], "score": min(1.0, max(0.0, float(x))), "ord": meta[j][2]} for j, x in zip(kept, scores)]
        return pd.Series(out, dtype=object)

    return queries.withColumn("subtree", score(F.col(vector)))


# --- beam walks ---


def _beam(path: Column, confidences: Column) -> Column:
    return F.struct((-F.element_at(confidences, -1)).alias("neg"), path.alias("path"), confidences.alias("confidences")).cast(BEAM)


def walk_from(start: Column, edges: Column, beam: int, max_depth: int) -> Column:
    """Follows scored edges from the starting beams and keeps the best ``beam`` paths of each level.

    A beam without scored children ends there. The result has the finished paths, most confident end first,
    ties by path. ``edges``: array of (parent_id, id, score).
    """
    kids = lambda b: F.filter(edges, lambda e: e["parent_id"] == F.element_at(b["path"], -1))
    grow = lambda b: F.transform(
        kids(b), lambda e: _beam(F.concat(b["path"], F.array(e["id"])), F.concat(b["confidences"], F.array(e["score"])))
    )

    def step(state: Column, _level: Column) -> Column:
        ended = F.filter(state["beams"], lambda b: F.size(kids(b)) == 0)
        grown = F.flatten(F.transform(state["beams"], grow))
        return F.struct(
            F.slice(F.array_sort(grown), 1, beam).alias("beams"), F.concat(state["ended"], ended).alias("ended")
        )

    empty = F.array().cast(f"array<{BEAM}>")
    first = F.struct(start.cast(f"array<{BEAM}>").alias("beams"), empty.alias("ended"))
    levels = F.sequence(F.lit(1), F.lit(max_depth - 1)) if max_depth > 1 else F.array().cast("array<int>")
    done = F.aggregate(levels, first, step, lambda s: F.array_sort(F.concat(s["ended"], s["beams"])))
    return F.transform(done, lambda b: F.struct(b["path"].alias("path"), b["confidences"].alias("confidences")))


def similarity_walk(subtree: Column, beam: int = 2, max_depth: int = 6) -> Column:
    """Beam search by similarity inside a scored subtree."""
    if beam <= 0 or max_depth <= 0:
        return F.array().cast("array<struct<path:array<string>,confidences:array<double>>>")
    roots = F.transform(F.filter(subtree, lambda n: n["parent_id"].isNull()), lambda n: _beam(F.array(n["id"]), F.array(n["score"])))
    return walk_from(F.slice(F.array_sort(roots), 1, beam), subtree, beam, max_depth)


def scored_walk(subtree: Column, scores: Column, beam: int = 2, max_depth: int = 6) -> Column:
    """Beam search on scores from outside: the first roots start at 1.0 and unscored nodes end their beam.

    ``subtree``: array of (parent_id, id, ord) kept nodes; ``scores``: array of (parent_id, id, score).
    """
    if beam <= 0 or max_depth <= 0:
        return F.array().cast("array<struct<path:array<string>,confidences:array<double>>>")
    roots = F.array_sort(
        F.transform(F.filter(subtree, lambda n: n["parent_id"].isNull()), lambda n: F.struct(n["ord"].alias("ord"), n["id"].alias("id")))
    )
    start = F.transform(F.slice(roots, 1, beam), lambda r: _beam(F.array(r["id"]), F.array(F.lit(1.0))))
    kept = F.filter(
        F.coalesce(scores, F.array().cast("array<struct<parent_id:string,id:string,score:double>>")),
        lambda s: F.exists(subtree, lambda n: (n["id"] == s["id"]) & (n["parent_id"] == s["parent_id"])),
    )
    return walk_from(start, kept, beam, max_depth)


def reject(path: Column, confidences: Column, thresholds: tuple[float, ...] = LEVEL_THRESHOLDS) -> Column:
    """The path up to the first level below its threshold; null when the first level already is."""
    limits = F.array(*map(F.lit, thresholds))
    level_ok = F.transform(
        confidences, lambda c, i: c >= F.coalesce(F.get(limits, i), F.lit(thresholds[-1]))
    )
    first_bad = F.coalesce(F.array_position(level_ok, False).cast("int"), F.lit(0))
    keep = F.when(first_bad == 0, F.size(path)).otherwise(first_bad - 1)
    trimmed = F.struct(F.slice(path, F.lit(1), keep).alias("path"), F.slice(confidences, F.lit(1), keep).alias("confidences"))
    return F.when(keep > 0, trimmed)


def tree_paths(
    queries: DataFrame, nodes: DataFrame, k: int = 20, beam: int = 2, max_depth: int = 6,
    thresholds: tuple[float, ...] = LEVEL_THRESHOLDS, vector: str = "embedding",
) -> DataFrame:
    """Nearest nodes, pruned subtree, beam walk and level rejection: adds ``paths`` to each query."""
    walked = similarity_walk(F.col("subtree"), beam, max_depth)
    trimmed = F.filter(F.transform(walked, lambda w: reject(w["path"], w["confidences"], thresholds)), lambda p: p.isNotNull())
    return with_subtree(queries, nodes, k, vector).withColumn("paths", trimmed).drop("subtree")


def parse_scores(text: Column, children: Column) -> Column:
    """Scores in a model's reply as (index, confidence), 0-based, first of an index wins, confidence clamped.

    Text fences are stripped; a reply that is not a JSON list gives an empty array, bad items are dropped.
    """
    bare = F.regexp_replace(F.trim(F.regexp_replace(text, r"^\s+|\s+$", "")), r"^```[a-zA-Z0-9_-]*\s*\n?", "")
    bare = F.regexp_replace(bare, r"```$", "")
    items = F.coalesce(F.try_parse_json(bare).try_cast("array<variant>"), F.array().cast("array<variant>"))
    read = F.transform(
        items,
        lambda v: F.struct(
            F.floor(F.try_variant_get(v, "$.index", "double")).cast("int").alias("index"),
            F.try_variant_get(v, "$.confidence", "double").alias("confidence"),
        ),
    )
    valid = F.filter(
        F.transform(read, lambda s: F.struct((s["index"] - 1).alias("index"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), s["confidence"])).alias("confidence"), s["confidence"].isNotNull().alias("ok"))),
        lambda s: s["ok"] & (s["index"] >= 0) & (s["index"] < children),
    )
    entry = "array<struct<index:int,confidence:double>>"
    return F.aggregate(
        valid, F.array().cast(entry),
        lambda kept, s: F.when(F.exists(kept, lambda k: k["index"] == s["index"]), kept).otherwise(
            F.concat(kept, F.array(F.struct(s["index"].alias("index"), s["confidence"].alias("confidence"))))
        ),
    )


def strip_thinking(text: Column, marker: str = "</think>") -> Column:
    """Drops everything up to the end of a thinking block."""
    at = F.instr(text, marker)
    return F.when(at > 0, F.trim(F.substr(text, at + len(marker)))).otherwise(text)


# --- taggers ---


def query_text() -> Column:
    """The text a vector tagger embeds: the user's non-empty messages on lines of their own."""
    kept = F.filter(F.transform(user_messages(), lambda m: m["content"]), lambda c: F.coalesce(c, F.lit("")) != "")
    return F.trim(F.array_join(kept, "\n"))


def embedding_tags(
    calls: DataFrame, nodes: DataFrame, k: int = 5, min_similarity: float = 0.35, vector: str = "embedding",
    column: str = "embedding_tags",
) -> DataFrame:
    """Tags of the nearest leaves at or above a similarity, as candidate verdicts."""
    tags = F.transform(
        F.filter("_hits", lambda h: h["similarity"] >= min_similarity),
        lambda h: verdict(
            "tags", F.element_at(F.split(h["id"], "/"), -1),
            F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), h["similarity"])), 4), "embedding-nn", "embedding_tagger",
            metadata={"path": h["id"], "similarity": F.bround(h["similarity"], 4)},
        ),
    )
    return top_k(calls, leaves(nodes), k, vector, "_hits").withColumn(column, tags).drop("_hits")


def tree_path_tags(calls: DataFrame, nodes: DataFrame, column: str = "tree_path_tags", **walk) -> DataFrame:
    """The end of each accepted path as a candidate verdict."""
    tags = F.transform(
        "paths",
        lambda p: verdict(
            "tags", F.element_at(p["path"], -1), F.element_at(p["confidences"], -1), "tree-path", "tree_path_tagger",
            metadata={"path": F.array_join(p["path"], ">"),
                      "path_confidences": F.array_join(F.transform(p["confidences"], lambda c: c.cast("string")), ",")},
        ),
    )
    return tree_paths(calls, nodes, **walk).withColumn(column, tags).drop("paths")


# --- maintenance ---


def _grams(text: str, size: int = 3) -> Column:
    """All distinct substrings of ``text`` of up to ``size`` characters, the empty one too."""
    at = F.sequence(F.lit(1), F.length(text) + 1)
    pieces = F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(0), F.lit(size)), lambda n: F.substr(F.col(text), i, n))))
    return F.array_distinct(pieces)


def _containing(segments: DataFrame, labels: DataFrame) -> DataFrame:
    """For each segment the smallest label that contains it or is contained in it. Texts meet at the first characters of
    the contained one, which are among the substrings of the other; the empty text meets the smallest label alone."""
    head = lambda c: F.substr(F.col(c), F.lit(1), F.lit(3))
    named = labels.filter("label <> ''")
    inside = segments.select("segment", F.explode(_grams("segment")).alias("gram")).join(labels.select("label", head("label").alias("gram")), "gram")
    around = segments.filter("segment <> ''").select("segment", head("segment").alias("gram")).join(named.select("label", F.explode(_grams("label")).alias("gram")), "gram")
    least = labels.agg(F.min("label").alias("label"))
    empty = segments.filter("segment = ''").join(F.broadcast(least)).select("segment", "label")  # one row
    near = inside.filter(F.contains("segment", "label")).select("segment", "label").unionByName(around.filter(F.contains("label", "segment")).select("segment", "label"))
    return near.unionByName(empty).groupBy("segment").agg(F.min("label").alias("near"))


def match_labels(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """Finds each old path (``path``, ``n``) in a new taxonomy: by id, then by a segment equal to a label from the
    right, then by a segment that contains or is contained in a label (smallest label wins)."""
    labels = nodes.select("label").filter("label is not null").distinct()
    suffix = "(" + "|".join(LABEL_SUFFIXES) + ")$"
    segments = F.reverse(F.transform(F.split("path", "/"), lambda s: F.regexp_replace(s, suffix, "")))
    parts = paths.select("path").distinct().select("path", F.posexplode(segments).alias("at", "segment"))
    equal = parts.join(labels, parts["segment"] == labels["label"]).groupBy("path").agg(F.min_by("label", "at").alias("equal"))
    known = nodes.select(F.col("id").alias("path"), F.lit(True).alias("_known")).distinct()
    open_ = parts.join(equal, "path", "left_anti").join(known, "path", "left_anti")
    near = open_.join(_containing(open_.select("segment").distinct(), labels), "segment").groupBy("path").agg(F.min_by("near", "at").alias("near"))
    found = F.when(F.col("_known"), F.col("path")).otherwise(F.coalesce("equal", "near"))
    return paths.join(known, "path", "left").join(equal, "path", "left").join(near, "path", "left").withColumn("match", found).select(*paths.columns, "match")


def label_coverage(matched: DataFrame, target: float = 0.95) -> DataFrame:
    """Share of paths and of their volume that found a match, and whether it reaches the target."""
    ok = F.col("match").isNotNull()
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    paths, hits = F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))
    found = share(F.count_if(ok), F.greatest(paths, F.lit(1)))
    return matched.agg(
        paths.alias("paths"), F.count_if(ok).alias("matched_paths"), found.alias("path_coverage"),
        share(F.sum(F.when(ok, F.col("n"))), F.greatest(hits, F.lit(1))).alias("volume_coverage"),
        F.when(found >= target, F.lit("PASS")).otherwise(F.lit("FAIL")).alias("status"),
    )


def new_children(candidates: DataFrame, nodes: DataFrame) -> DataFrame:
    """Valid proposed children (``parent_id``, ``label``, ``description``): good label, not there yet, described."""
    valid = candidates.filter(
        F.col("label").rlike("^[a-z0-9][a-z0-9-]*$") & (F.trim(F.coalesce("description", F.lit(""))) != "")
    )
    fresh = valid.join(nodes.select("parent_id", "label"), ["parent_id", "label"], "left_anti")
    return fresh.groupBy("parent_id", "label").agg(F.min(F.trim("description")).alias("description"))


def merge_children(nodes: DataFrame, fresh: DataFrame) -> DataFrame:
    """The node table with the new children placed behind the existing ones."""
    last = nodes.groupBy("parent_id").agg((F.max("ord") + 1).alias("_next"))
    order = F.row_number().over(Window.partitionBy("parent_id").orderBy("label")) - 1
    placed = fresh.withColumn("_rank", order).join(last, "parent_id", "left")
    added = placed.select(
        F.concat_ws("/", "parent_id", "label").alias("id"), "parent_id", "label", "description",
        (F.coalesce("_next", F.lit(0)) + F.col("_rank")).cast("int").alias("ord"),
    )
    return nodes.select("id", "parent_id", "label", "description", "ord").unionByName(added)

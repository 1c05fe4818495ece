"""Nearest nodes, pruning, beam walks and taxonomy upkeep over the embedding and page tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from facetledger.operators import resolve as rs
from facetledger.operators import taxonomy as tx
from facetledger.operators.classify import candidates_column, with_candidates
from facetledger.plans.registry import plain, query
from facetledger.sources.tables import load, taxonomy_nodes

NODES_CTE = """
WITH lv AS (SELECT label, concat('a', label % 2) AS a, concat('a', label % 2, '/b', label % 4) AS b,
    concat('a', label % 2, '/b', label % 4, '/c', label) AS c, embedding FROM embeddings),
m AS (SELECT id, parent_id, ord, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS x FROM (
    SELECT a AS id, NULL AS parent_id, label % 2 AS ord, embedding FROM lv UNION ALL
    SELECT b, a, label % 4, embedding FROM lv UNION ALL SELECT c, b, label, embedding FROM lv)),
mean AS (SELECT id, parent_id, ord, pos, avg(x) AS m FROM m GROUP BY ALL),
norm AS (SELECT id, sqrt(sum(m * m)) AS l FROM mean GROUP BY 1),
nodes AS (SELECT id, parent_id, ord, list(m / l ORDER BY pos) AS v, split_part(id, '/', -1) AS label FROM mean JOIN norm USING (id) GROUP BY ALL),
q AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
sims AS (SELECT vec_id, n.id, n.parent_id, n.ord, list_dot_product(q.v, n.v) AS s FROM q, nodes n),
"""


def vectors(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").select("vec_id", "embedding")


@query(
    "topk_cosine",
    f"{NODES_CTE} r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, id) AS rk FROM sims) "
    "SELECT vec_id, CAST(rk AS INT) AS rank, id, round(s, 6) AS similarity FROM r WHERE rk <= 5",
)
def topk_cosine(spark, sf_dir):
    hits = tx.top_k(vectors(spark, sf_dir), taxonomy_nodes(spark, sf_dir), 5)
    return plain(hits.select("vec_id", F.posexplode("hits").alias("p", "h")).select("vec_id", (F.col("p") + 1).alias("rank"), "h.id", "h.similarity"))


@query(
    "embedding_tags",
    f"{NODES_CTE} r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, id) AS rk FROM sims WHERE id LIKE '%/%/%') "
    "SELECT vec_id, split_part(id, '/', 3) AS value, round_even(least(1.0, greatest(0.0, s)), 4) AS confidence FROM r WHERE rk <= 3 AND s >= 0.35",
)
def embedding_tags(spark, sf_dir):
    tagged = tx.embedding_tags(vectors(spark, sf_dir), taxonomy_nodes(spark, sf_dir), k=3)
    return plain(tagged.select("vec_id", F.inline("embedding_tags")).select("vec_id", "value", "confidence"), 4)


@query(
    "taxonomy_leaves",
    f"{NODES_CTE} z AS (SELECT 1) SELECT id, label FROM nodes WHERE id NOT IN (SELECT parent_id FROM nodes WHERE parent_id IS NOT NULL)",
)
def taxonomy_leaves(spark, sf_dir):
    return tx.leaves(taxonomy_nodes(spark, sf_dir)).select("id", "label")


@query(
    "taxonomy_paths",
    f"{NODES_CTE} z AS (SELECT 1) SELECT id, len(string_split(id, '/')) AS depth, replace(CASE len(string_split(id, '/')) WHEN 1 THEN id "
    "WHEN 2 THEN concat(parent_id, '>', id) ELSE concat(split_part(id, '/', 1), '>', parent_id, '>', id) END, '', '') AS path FROM nodes",
)
def taxonomy_paths(spark, sf_dir):
    return tx.with_paths(taxonomy_nodes(spark, sf_dir)).select("id", F.col("depth").cast("bigint").alias("depth"), F.array_join("path", ">").alias("path"))


SUBTREE_CTE = (
    f"{NODES_CTE} seed AS (SELECT vec_id, id FROM sims QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, id) <= 4), "
    "pre AS (SELECT vec_id, unnest([split_part(id, '/', 1), CASE WHEN id LIKE '%/%' THEN concat(split_part(id, '/', 1), '/', split_part(id, '/', 2)) ELSE id END, id]) AS id FROM seed), "
    "sub AS (SELECT DISTINCT vec_id, id FROM pre), t AS (SELECT sims.vec_id, sims.id, parent_id, ord, least(1.0, greatest(0.0, s)) AS s FROM sims JOIN sub ON sims.vec_id = sub.vec_id AND sims.id = sub.id) "
)


@query("prune_subtree", f"{SUBTREE_CTE} SELECT vec_id, id FROM sub")
def prune_subtree(spark, sf_dir):
    nodes = taxonomy_nodes(spark, sf_dir)
    seeds = tx.top_k(vectors(spark, sf_dir), nodes, 4).select("vec_id", F.explode("hits").alias("h")).select("vec_id", F.col("h.id").alias("node_id"))
    return tx.prune(nodes.drop("vector"), seeds, "vec_id").select("vec_id", "id")


@query(
    "subtree_children",
    f"{SUBTREE_CTE} SELECT vec_id, parent_id, string_agg(id, ',' ORDER BY ord) AS children FROM t GROUP BY ALL",
)
def subtree_children(spark, sf_dir):
    nodes = taxonomy_nodes(spark, sf_dir)
    seeds = tx.top_k(vectors(spark, sf_dir), nodes, 4).select("vec_id", F.explode("hits").alias("h")).select("vec_id", F.col("h.id").alias("node_id"))
    children = tx.subtree_children(tx.prune(nodes.drop("vector"), seeds, "vec_id"), "vec_id")
    return children.select("vec_id", "parent_id", F.array_join("children", ",").alias("children"))


def walk_cte(start: str, edges: str) -> str:
    """The walk level by level: beams of level 1, children of the beams, ended beams."""
    grow = lambda level: (
        "SELECT * FROM (SELECT b.vec_id AS vec_id, list_append(b.path, e.id) AS path, list_append(b.c, e.s) AS c, e.s AS s "
        f"FROM {level} b JOIN {edges} e ON e.vec_id = b.vec_id AND e.parent_id = b.path[-1]) "
        "QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, path) <= 2"
    )
    return f"""
b1 AS ({start}),
b2 AS ({grow('b1')}),
b3 AS ({grow('b2')}),
w AS (SELECT * FROM b1 b WHERE NOT EXISTS (SELECT 1 FROM {edges} e WHERE e.vec_id = b.vec_id AND e.parent_id = b.path[-1])
  UNION ALL SELECT * FROM b2 b WHERE NOT EXISTS (SELECT 1 FROM {edges} e WHERE e.vec_id = b.vec_id AND e.parent_id = b.path[-1])
  UNION ALL SELECT * FROM b3)
"""


WALK_CTE = f"{SUBTREE_CTE}, " + walk_cte(
    "SELECT vec_id, [id] AS path, [s] AS c, s FROM t WHERE parent_id IS NULL QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, id) <= 2", "t"
)


@query(
    "beam_walk",
    f"{WALK_CTE} SELECT vec_id, array_to_string(path, '>') AS path, round(s, 6) AS confidence FROM w",
)
def beam_walk(spark, sf_dir):
    scored = tx.with_subtree(vectors(spark, sf_dir), taxonomy_nodes(spark, sf_dir), 4)
    walked = scored.select("vec_id", F.inline(tx.similarity_walk(F.col("subtree"))))
    return plain(walked.select("vec_id", F.array_join("path", ">").alias("path"), F.element_at("confidences", -1).alias("confidence")))


LIMITS = (0.20, 0.30, 0.35)


@query(
    "level_rejection",
    f"{WALK_CTE}, z AS (SELECT vec_id, path, c, CASE WHEN c[1] < 0.2 THEN 0 WHEN len(c) > 1 AND c[2] < 0.3 THEN 1 WHEN len(c) > 2 AND c[3] < 0.35 THEN 2 ELSE len(c) END AS keep FROM w) "
    "SELECT vec_id, array_to_string(path[1:keep], '>') AS path, round(c[keep], 6) AS confidence FROM z WHERE keep > 0",
)
def level_rejection(spark, sf_dir):
    paths = tx.tree_paths(vectors(spark, sf_dir), taxonomy_nodes(spark, sf_dir), k=4, thresholds=LIMITS).select("vec_id", F.inline("paths"))
    return plain(paths.select("vec_id", F.array_join("path", ">").alias("path"), F.element_at("confidences", -1).alias("confidence")))


@query(
    "tree_path_tags",
    f"{WALK_CTE}, z AS (SELECT vec_id, path, c, CASE WHEN c[1] < 0.2 THEN 0 WHEN len(c) > 1 AND c[2] < 0.3 THEN 1 WHEN len(c) > 2 AND c[3] < 0.35 THEN 2 ELSE len(c) END AS keep FROM w), "
    "v AS (SELECT vec_id, path[keep] AS value, max(c[keep]) AS confidence FROM z WHERE keep > 0 AND c[keep] >= 0.4 GROUP BY ALL) SELECT vec_id, value, round(confidence, 6) AS confidence FROM v",
)
def tree_path_tags(spark, sf_dir):
    tagged = tx.tree_path_tags(vectors(spark, sf_dir), taxonomy_nodes(spark, sf_dir), k=4, thresholds=LIMITS)
    calls = tagged.withColumn("messages", F.array().cast("array<struct<role:string,content:string>>"))
    candidates = with_candidates(calls, {"tree": candidates_column("tree_path_tags")})
    resolved = candidates.select("vec_id", F.inline(rs.resolve(F.col("candidates"))))
    return plain(resolved.select("vec_id", "value", "confidence"))


@query(
    "scored_walk",
    f"{NODES_CTE} e AS (SELECT vec_id, id, parent_id, CAST((ord * 37 + vec_id * 13) % 101 AS DOUBLE) / 100.0::DOUBLE AS s FROM sims WHERE parent_id IS NOT NULL AND (ord + vec_id) % 4 <> 0), "
    + walk_cte("SELECT vec_id, [id] AS path, [1.0::DOUBLE] AS c, 1.0::DOUBLE AS s FROM sims WHERE parent_id IS NULL", "e")
    + " SELECT vec_id, array_to_string(path, '>') AS path, round(s, 6) AS confidence FROM w",
)
def scored_walk(spark, sf_dir):
    nodes = taxonomy_nodes(spark, sf_dir).drop("vector")
    tree = nodes.agg(F.collect_list(F.struct("parent_id", "id", "ord"))).scalar()
    calls = vectors(spark, sf_dir).select("vec_id", tree.alias("subtree"))
    scores = F.transform(
        F.filter("subtree", lambda n: n["parent_id"].isNotNull() & ((n["ord"] + F.col("vec_id")) % 4 != 0)),
        lambda n: F.struct(n["parent_id"].alias("parent_id"), n["id"].alias("id"), (((n["ord"] * 37 + F.col("vec_id") * 13) % 101) / 100.0).alias("score")),
    )
    walked = calls.withColumn("scores", scores).select("vec_id", F.inline(tx.scored_walk(F.col("subtree"), F.col("scores"))))
    return plain(walked.select("vec_id", F.array_join("path", ">").alias("path"), F.element_at("confidences", -1).alias("confidence")))


@query(
    "score_replies",
    "SELECT vec_id, index, confidence FROM (SELECT vec_id, vec_id % 3 AS index, CAST(vec_id % 7 AS DOUBLE) / 5.0::DOUBLE AS c FROM embeddings WHERE vec_id % 4 <> 3), "
    "LATERAL (SELECT least(1.0, c) AS confidence) UNION ALL SELECT vec_id, (vec_id + 1) % 3, 0.0::DOUBLE FROM embeddings WHERE vec_id % 4 <> 3",
)
def score_replies(spark, sf_dir):
    body = (
        "concat('[{\"index\": ', vec_id % 3 + 1, ', \"confidence\": ', cast(vec_id % 7 as double) / 5, '}, {\"index\": ', vec_id % 3 + 1, "
        "', \"confidence\": 0.1}, {\"index\": 9, \"confidence\": 1}, 5, {\"confidence\": 0.5}, {\"index\": ', (vec_id + 1) % 3 + 1, ', \"confidence\": -2, \"why\": \"x\"}]')"
    )
    replies = load(spark, sf_dir, "embeddings").selectExpr(
        "vec_id", f"case vec_id % 4 when 0 then {body} when 1 then concat('```json\n', {body}, '\n```') when 2 then concat('  ', {body}) else 'no list' end as text"
    )
    parsed = replies.select("vec_id", F.inline(tx.parse_scores(F.col("text"), F.lit(3))))
    return plain(parsed.select("vec_id", F.col("index").cast("bigint").alias("index"), "confidence"))


OLD_PATHS = "concat(CASE WHEN vec_id % 5 = 0 THEN 'x/' WHEN vec_id % 5 = 1 THEN 'a1/' ELSE 'top/' END, CASE vec_id % 4 WHEN 0 THEN concat('b', vec_id % 9, '-fan') WHEN 1 THEN concat('c', label) WHEN 2 THEN 'zz' ELSE concat('long-c', label, '-name') END)"


@query(
    "label_mapping",
    f"""{NODES_CTE} old AS (SELECT {OLD_PATHS} AS path, count(*) AS n FROM embeddings GROUP BY 1),
p AS (SELECT path, n, regexp_replace(split_part(path, '/', 2), '(-fan|-focus|-personal|-corp)$', '') AS s2, split_part(path, '/', 1) AS s1 FROM old),
labels AS (SELECT DISTINCT label FROM nodes)
SELECT path, n, coalesce((SELECT label FROM labels WHERE label = s2), (SELECT label FROM labels WHERE label = s1),
  (SELECT min(label) FROM labels WHERE contains(label, s2) OR contains(s2, label)), (SELECT min(label) FROM labels WHERE contains(label, s1) OR contains(s1, label))) AS match FROM p""",
)
def label_mapping(spark, sf_dir):
    old = load(spark, sf_dir, "embeddings").selectExpr(f"{OLD_PATHS} as path").groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    return tx.match_labels(old, taxonomy_nodes(spark, sf_dir).drop("vector"))


@query(
    "label_coverage",
    f"""{NODES_CTE} old AS (SELECT {OLD_PATHS} AS path, count(*) AS n FROM embeddings GROUP BY 1),
p AS (SELECT path, n, regexp_replace(split_part(path, '/', 2), '(-fan|-focus|-personal|-corp)$', '') AS s2, split_part(path, '/', 1) AS s1 FROM old),
f AS (SELECT p.*, EXISTS (SELECT 1 FROM nodes WHERE contains(label, s2) OR contains(s2, label) OR contains(label, s1) OR contains(s1, label)) AS ok FROM p)
SELECT count(*) AS paths, count(*) FILTER (WHERE ok) AS matched_paths, round(count(*) FILTER (WHERE ok) / count(*), 6) AS path_coverage,
  round(coalesce(sum(n) FILTER (WHERE ok), 0) / sum(n), 6) AS volume_coverage, CASE WHEN count(*) FILTER (WHERE ok) / count(*) >= 0.95 THEN 'PASS' ELSE 'FAIL' END AS status FROM f""",
)
def label_coverage(spark, sf_dir):
    return plain(tx.label_coverage(label_mapping(spark, sf_dir)))


PROPOSED = "concat('a', label % 2) AS parent_id, CASE vec_id % 5 WHEN 0 THEN concat('b', vec_id % 4) WHEN 1 THEN concat('New', vec_id % 3) WHEN 2 THEN concat('new-', vec_id % 6) ELSE concat('idea-', label) END AS label, CASE WHEN vec_id % 7 = 0 THEN ' ' ELSE ' made up ' END AS description"


@query(
    "new_children",
    f"{NODES_CTE} c AS (SELECT {PROPOSED} FROM embeddings) SELECT DISTINCT parent_id, label, 'made up' AS description FROM c WHERE regexp_matches(label, '^[a-z0-9][a-z0-9-]*$') "
    "AND trim(description) <> '' AND (parent_id, label) NOT IN (SELECT parent_id, label FROM nodes WHERE parent_id IS NOT NULL)",
)
def new_children(spark, sf_dir):
    proposed = load(spark, sf_dir, "embeddings").selectExpr(*[p.strip() for p in split_columns(PROPOSED)])
    return tx.new_children(proposed, taxonomy_nodes(spark, sf_dir).drop("vector"))


def split_columns(text: str) -> list[str]:
    """Select items of a flat list where every item ends in an alias."""
    parts = text.replace(" AS parent_id, ", " AS parent_id|").replace(" AS label, ", " AS label|")
    return parts.split("|")


@query(
    "merged_children",
    f"{NODES_CTE} c AS (SELECT {PROPOSED} FROM embeddings), f AS (SELECT DISTINCT parent_id, label FROM c WHERE regexp_matches(label, '^[a-z0-9][a-z0-9-]*$') "
    "AND trim(description) <> '' AND (parent_id, label) NOT IN (SELECT parent_id, label FROM nodes WHERE parent_id IS NOT NULL)), "
    "x AS (SELECT parent_id, max(ord) + 1 AS nx FROM nodes GROUP BY 1) SELECT id, parent_id, CAST(ord AS INT) AS ord FROM nodes UNION ALL "
    "SELECT concat(f.parent_id, '/', f.label), f.parent_id, CAST(coalesce(nx, 0) + row_number() OVER (PARTITION BY f.parent_id ORDER BY f.label) - 1 AS INT) FROM f LEFT JOIN x USING (parent_id)",
)
def merged_children(spark, sf_dir):
    return tx.merge_children(taxonomy_nodes(spark, sf_dir).drop("vector"), new_children(spark, sf_dir)).select("id", "parent_id", "ord")


@query(
    "node_problems",
    f"{NODES_CTE} bad AS (SELECT id, parent_id, label FROM nodes UNION ALL SELECT id, parent_id, label FROM nodes WHERE parent_id IS NULL UNION ALL "
    "SELECT DISTINCT concat('n', label), 'nowhere', concat('x/', label) FROM embeddings) SELECT id, 'duplicate-id' AS problem FROM bad GROUP BY id HAVING count(*) > 1 "
    "UNION ALL SELECT id, 'bad-label' FROM bad WHERE contains(label, '/') UNION ALL SELECT id, 'missing-parent' FROM bad WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM bad)",
)
def node_problems(spark, sf_dir):
    nodes = taxonomy_nodes(spark, sf_dir).select("id", "parent_id", "label")
    stray = load(spark, sf_dir, "embeddings").selectExpr("concat('n', label) as id", "'nowhere' as parent_id", "concat('x/', label) as label").distinct()
    return tx.node_problems(nodes.unionByName(nodes.filter("parent_id is null")).unionByName(stray))


@query("hash_embeddings", "SELECT item_id, CAST(8 AS INT) AS dim, 1.0::DOUBLE AS norm FROM benchmark")
def hash_embeddings(spark, sf_dir):
    texts = load(spark, sf_dir, "benchmark").select("item_id", "text")
    embedded = tx.embed(texts, F.col("text"), tx.hash_embedder(8))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return embedded.select("item_id", F.size("embedding").alias("dim"), F.round(norm, 5).alias("norm"))


@query(
    "node_texts",
    "SELECT DISTINCT concat('c', label) AS id, CASE WHEN label % 2 = 0 THEN concat('topic ', label, ': about ', label) ELSE concat('topic ', label) END AS text FROM embeddings",
)
def node_texts(spark, sf_dir):
    nodes = load(spark, sf_dir, "embeddings").selectExpr(
        "concat('c', label) as id", "concat('topic ', label) as label", "if(label % 2 = 0, concat(' about ', label, ' '), ' ') as description"
    ).distinct()
    return nodes.select("id", tx.node_text().alias("text"))

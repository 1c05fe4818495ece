"""Facet classifiers as Column builders.

A classifier is a function of the call's columns that returns ``array<verdict>``. All of a call's verdicts are
concatenated and resolved in the row, so classifying costs no shuffle, no join and no Python.
Join-based classifiers (vector taggers) add a candidates column instead; see ``taxonomy``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetledger.schemas import FACETS, SCORED, VERDICT, VERDICTS
from facetledger.vocab import (
    BRANCH_ACTIVITY, BUSINESS_FRAGMENTS, DOMAIN_KEYWORDS, PERSONAL_FRAGMENTS, TAG_KEYWORDS, TEST_PATH_MARKS,
    TICKET_PATTERN,
)

Classifier = Callable[[], Column]
USER_LOWER = "_user_lower"


def none() -> Column:
    return F.array().cast(VERDICTS)


def verdict(
    facet: str, value: Column, confidence: Column | float, source: Column | str, name: str,
    alternatives: Column | None = None, metadata: dict[str, Column] | None = None,
) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    entries = [x for key, column in (metadata or {}).items() for x in (F.lit(key), column.cast("string"))]
    details = F.create_map(*entries) if entries else F.create_map()
    return F.struct(
        F.lit(facet).alias("facet"), value.cast("string").alias("value"), lit(confidence).cast("double").alias("confidence"),
        lit(source).alias("source"), F.lit(name).alias("classifier_name"),
        (alternatives if alternatives is not None else F.array()).cast(f"array<{SCORED}>").alias("alternatives"),
        details.cast("map<string,string>").alias("metadata"),
    ).cast(VERDICT)


def user_messages() -> Column:
    return F.filter(F.coalesce("messages", F.array().cast("array<struct<role:string,content:string>>")), lambda m: m["role"] == "user")


def bind(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a costly column that is computed once per row.

    Filters and projections move through a plain projection and would repeat its expression at every use; they do
    not move through the generator of this one-element array.
    """
    return rows.drop(name).select("*", F.explode(F.array(value)).alias(name))


def with_text(calls: DataFrame) -> DataFrame:
    """The user's text, joined and lower-cased once for all keyword classifiers."""
    text = F.array_join(F.transform(user_messages(), lambda m: F.coalesce(m["content"], F.lit(""))), " ")
    return bind(calls, USER_LOWER, F.lower(text))


def _any(text: Column, parts) -> Column:
    hit = F.lit(False)
    for part in parts:
        hit = hit | F.contains(text, F.lit(part))
    return hit


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluates ``value`` a single time for all its uses; ``use`` returns one verdict."""
    return F.transform(F.array(value), use)


def context_rules(personal=PERSONAL_FRAGMENTS, business=BUSINESS_FRAGMENTS) -> Column:
    """personal or business by fragments of the working directory; unknown at .50 without a sign."""
    workdir = F.lower(F.coalesce("working_directory", F.lit("")))
    value = F.when(_any(workdir, personal), F.lit("personal")).when(_any(workdir, business), F.lit("business")).otherwise(F.lit("unknown"))
    return _once(
        value,
        lambda v: verdict(
            "context", v, F.when(v == "unknown", 0.50).otherwise(0.85),
            F.when(v == "unknown", F.lit("default-unknown")).otherwise(F.concat(F.lit("workdir-"), v, F.lit("-fragment"))),
            "context_rules", metadata={"workdir": F.col("working_directory")},
        ),
    )


def domain_keywords(keywords: Mapping[str, tuple[str, ...]] = DOMAIN_KEYWORDS) -> Column:
    """The domain with most distinct keywords in the user's text, counted as substrings."""
    name = "domain_keywords"
    text = F.col(USER_LOWER)
    hits = lambda words: sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))
    scores = F.array(
        *[
            F.struct((-hits(words)).alias("n"), F.lit(i).alias("ord"), F.lit(domain).alias("domain"))
            for i, (domain, words) in enumerate(keywords.items())
        ]
    )
    ranked = F.array_sort(F.filter(scores, lambda s: s["n"] < 0))
    build = lambda r: F.transform(
        F.array(r),
        lambda s: verdict(
            "domain", s[0]["domain"], F.when(s[0]["n"] == -1, 0.60).otherwise(0.80),
            F.concat(F.lit("keywords-"), -s[0]["n"], F.lit("-hits")), name,
            alternatives=F.transform(
                F.slice(s, F.lit(2), F.size(s)),
                lambda a: F.struct(
                    a["domain"].alias("value"),
                    F.least(F.lit(0.60), F.lit(0.30) + F.lit(0.10) * (-a["n"])).alias("confidence"),
                ),
            ),
        ),
    )
    unknown = F.array(verdict("domain", F.lit("unknown"), 0.40, "default-unknown", name))
    # The ranked list is bound once by the one-element transform; an empty list falls back to unknown.
    return F.flatten(
        F.transform(F.array(ranked), lambda r: F.when(F.size(r) > 0, build(r)).otherwise(unknown))
    )


def activity_rules(branches: Mapping[str, str] = BRANCH_ACTIVITY, marks=TEST_PATH_MARKS) -> Column:
    """Activity by branch prefix, else verifying when a test file is touched, else unknown."""
    branch = F.lower(F.coalesce("git_context.branch", F.lit("")))
    touched = F.exists(
        F.col("tool_calls"), lambda t: _any(F.lower(F.coalesce(F.element_at(t["arguments"], "file_path"), F.lit(""))), marks)
    )
    prefix = F
    for name in branches:
        prefix = prefix.when(F.startswith(branch, F.lit(name)), F.lit(name))
    sign = prefix.when(F.coalesce(touched, F.lit(False)), F.lit("test-file-path")).otherwise(F.lit("default-unknown"))
    values = F.create_map(*[F.lit(x) for pair in {**branches, "test-file-path": "verifying", "default-unknown": "unknown"}.items() for x in pair])
    bare = lambda s: F.regexp_replace(s, "/+$", "")
    return _once(
        sign,
        lambda s: verdict(
            "activity", F.element_at(values, s), F.when(s == "default-unknown", 0.50).when(s == "test-file-path", 0.80).otherwise(0.90),
            F.when(s.isin("default-unknown", "test-file-path"), s).otherwise(F.concat(F.lit("git-branch-prefix-"), bare(s))),
            "activity_rules", metadata={"branch": F.col("git_context.branch")},
        ),
    )


def _projects(values: Column, confidence: float, source: str, name: str, **metadata: Column) -> Column:
    return F.transform(values, lambda v: verdict("project", v, confidence, source, name, metadata=metadata))


def project_explicit() -> Column:
    """Projects declared by request tag, hashtag or command."""
    name = "project_explicit"
    tag = F.element_at("request_tags", "project")
    by_tag = F.when(F.coalesce(tag, F.lit("")) != "", F.array(verdict("project", tag, 1.0, "request-tag-project", name)))
    hashtags = F.filter("in_prompt.hashtags", lambda h: h.rlike(r"(?s)^project:."))
    by_hashtag = F.transform(
        hashtags, lambda h: verdict("project", F.substr(h, F.lit(9)), 1.0, "in-prompt-hashtag", name)
    )
    commands = F.filter(
        "in_prompt.commands", lambda c: c["name"].isin("project", "new-project") & F.coalesce(c["args"], F.lit("")).rlike(r"\S")
    )
    by_command = F.transform(
        commands,
        lambda c: verdict(
            "project", F.regexp_extract(c["args"], r"^\s*(\S+)", 1), 1.0, F.concat(F.lit("in-prompt-command-"), c["name"]), name
        ),
    )
    return F.concat(*[F.coalesce(part, none()) for part in (by_tag, by_hashtag, by_command)])


def project_git_repo() -> Column:
    repo = F.col("git_context.repo")
    found = F.array(verdict("project", repo, 0.95, "git-repo-name", "project_git_repo"))
    return F.when(F.coalesce(repo, F.lit("")) != "", found).otherwise(none())


def _tickets(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TICKET_PATTERN), F.lit(1))


def project_git_branch() -> Column:
    """Ticket codes in the branch name, first-seen order."""
    branch = F.coalesce("git_context.branch", F.lit(""))
    return _projects(F.array_distinct(_tickets(branch)), 0.85, "git-branch-ticket", "project_git_branch", branch=branch)


def project_ticket_ref() -> Column:
    """Ticket codes in the user's messages."""
    codes = F.flatten(F.transform(user_messages(), lambda m: _tickets(F.coalesce(m["content"], F.lit("")))))
    return _projects(F.array_distinct(codes), 0.90, "prompt-ticket-ref", "project_ticket_ref")


def project_workdir() -> Column:
    base = F.substring_index(F.regexp_replace(F.coalesce("working_directory", F.lit("")), r"[/\\]+$", ""), "/", -1)
    found = F.array(verdict("project", base, 0.80, "workdir-basename", "project_workdir"))
    return F.when(base != "", found).otherwise(none())


def with_team_projects(calls: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds ``team_project`` from a (team_alias, project) table. The table is broadcast only when counted small."""
    named = registry.select("team_alias", F.col("project").alias("team_project"))
    return calls.join(named, "team_alias", "left")


def project_team_registry(project: Column | None = None) -> Column:
    """The registered project of the call's team; emits nothing without a registry."""
    if project is None:
        return none()
    found = F.array(
        verdict("project", project, 1.0, "team-registry", "project_team_registry", metadata={"team_alias": F.col("team_alias")})
    )
    return F.when(project.isNotNull(), found).otherwise(none())


def keyword_pattern(words) -> str:
    """Whole-word alternation; word characters are Unicode letters, digits and underscore."""
    escaped = ["".join(c if c.isalnum() or c in " _" else "\\" + c for c in w) for w in words]
    return r"(?U)\b(?:" + "|".join(escaped) + r")\b"


def keyword_tagger(keywords: Mapping[str, tuple[str, ...]] = TAG_KEYWORDS) -> Column:
    """Tags whose words occur in the user's text; 1, 2 or 3 and more occurrences give .50, .65, .80."""
    counted = F.array(
        *[
            F.struct(F.lit(tag).alias("tag"), F.regexp_count(F.col(USER_LOWER), F.lit(keyword_pattern(words))).alias("n"))
            for tag, words in keywords.items()
        ]
    )
    return F.transform(
        F.filter(counted, lambda c: c["n"] > 0),
        lambda c: verdict(
            "tags", c["tag"], F.when(c["n"] == 1, 0.50).when(c["n"] == 2, 0.65).otherwise(0.80),
            F.concat(F.lit("keyword-"), c["n"], F.lit("-hits")), "keyword_tagger", metadata={"hit_count": c["n"]},
        ),
    )


def session_continuity(facet: str, state: str = "session_state", cap: float = 0.75, min_inherit: float = 0.5) -> Column:
    """The session's current value of a facet at a capped confidence. ``state``: map of facet to its state."""
    if facet not in FACETS:
        raise ValueError(f"unknown facet {facet!r}")
    current = F.element_at(F.col(state), facet)
    found = F.array(
        verdict(
            facet, current["value"], F.least(current["confidence"], F.lit(cap)),
            F.concat(F.lit("session-inherited-from-"), current["call_id"]), f"session_continuity:{facet}",
            metadata={"inherited_from_call": current["call_id"], "original_source": current["source"],
                      "original_confidence": current["confidence"]},
        )
    )
    return F.when(current["confidence"] >= min_inherit, found).otherwise(none())


def candidates_column(column: str) -> Classifier:
    """A classifier that reads verdicts another operator has put in a column (vector taggers)."""
    return lambda: F.coalesce(F.col(column), none())


def default_classifiers(**replaced: Classifier) -> dict[str, Classifier]:
    """The default set by name, in order; a keyword replaces one. Vector taggers emit nothing by default."""
    classifiers: dict[str, Classifier] = {
        "context_rules": context_rules,
        "domain_keywords": domain_keywords,
        "activity_rules": activity_rules,
        "project_explicit": project_explicit,
        "project_git_repo": project_git_repo,
        "project_git_branch": project_git_branch,
        "project_workdir": project_workdir,
        "project_ticket_ref": project_ticket_ref,
        "project_team_registry": project_team_registry,
        "keyword_tagger": keyword_tagger,
        "embedding_tagger": none,
        "tree_path_tagger": none,
    }
    unknown = set(replaced) - set(classifiers)
    if unknown:
        raise ValueError(f"no such classifiers: {sorted(unknown)}")
    return {**classifiers, **replaced}


def with_candidates(calls: DataFrame, classifiers: Mapping[str, Classifier] | None = None) -> DataFrame:
    """All verdicts of all classifiers, in classifier order, as ``candidates``."""
    chosen = classifiers or default_classifiers()
    built = F.concat(*[build() for build in chosen.values()])
    return bind(with_text(calls), "candidates", built).drop(USER_LOWER)

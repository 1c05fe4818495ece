"""Row types and the facet registry."""

from __future__ import annotations

from dataclasses import dataclass, replace

SCHEMA_VERSION = 1

MESSAGE = "struct<role:string,content:string>"
TOOL_CALL = "struct<name:string,arguments:map<string,string>>"
GIT = "struct<repo:string,branch:string,ref:string>"
SIGNALS = "struct<hashtags:array<string>,commands:array<struct<name:string,args:string>>>"
SCORED = "struct<value:string,confidence:double>"
VERDICT = (
    "struct<facet:string,value:string,confidence:double,source:string,classifier_name:string,"
    f"alternatives:array<{SCORED}>,metadata:map<string,string>>"
)
VERDICTS = f"array<{VERDICT}>"
FACET_STATE = "struct<value:string,confidence:double,last_updated:timestamp,call_id:string,source:string>"

CALL = (
    "call_id string, session_id string, timestamp timestamp, agent string, model string, "
    f"messages array<{MESSAGE}>, tool_calls array<{TOOL_CALL}>, request_tags map<string,string>, "
    f"team_alias string, user_id string, working_directory string, git_context {GIT}, in_prompt {SIGNALS}"
)

TOKENS = "struct<input:bigint,output:bigint,cache_creation:bigint,cache_read:bigint>"
FACETS_STRUCT = (
    f"struct<context:{SCORED},domain:{SCORED},activity:{SCORED},"
    f"project:array<{SCORED}>,tags:array<{SCORED}>>"
)
# One line of the spend log as written. The timestamp stays text until it has been checked.
SPEND_LINE = (
    "schema_version int, timestamp string, call_id string, session_id string, model string, agent string, "
    f"pipeline_version string, cost_usd decimal(18,6), tokens {TOKENS}, facets {FACETS_STRUCT}, "
    "prompt_prefix string, classifier_error string"
)


@dataclass(frozen=True)
class Facet:
    """How one facet is resolved: one winner, or up to ``top_n`` values, above ``min_confidence``."""

    name: str
    array: bool = False
    min_confidence: float = 0.5
    top_n: int = 3
    default: tuple[str, ...] = ("unknown",)


FACETS: dict[str, Facet] = {
    f.name: f
    for f in (
        Facet("context"),
        Facet("domain"),
        Facet("activity"),
        Facet("project", array=True),
        Facet("tags", array=True, min_confidence=0.4, top_n=5, default=()),
    )
}
SCALAR_FACETS = tuple(f.name for f in FACETS.values() if not f.array)
ARRAY_FACETS = tuple(f.name for f in FACETS.values() if f.array)


def override_facet(name: str, **changes) -> dict[str, Facet]:
    """The registry with one facet changed, e.g. ``override_facet("tags", min_confidence=0.2)``."""
    return {**FACETS, name: replace(FACETS[name], **changes)}

"""The patterns and word lists that define what the text operators find.

Patterns are written once and used with the flags that each engine needs;
``any_of`` joins them into one alternation, so a text is scanned once.
"""

from __future__ import annotations

# Phrases of a user who corrects the assistant.
CORRECTION = [
    r"\bno[,.]?\s+that'?s\s+(not|wrong|incorrect)",
    r"\bdon'?t\s+do\s+that",
    r"\bI\s+(said|meant)\s+",
    r"\bwrong\s+(file|path|dir|approach|method|function|model|endpoint)",
    r"\bthat\s+broke",
    r"\bundo\s+(that|this|it)",
    r"\bthat'?s\s+not\s+what\s+I",
    r"\byou\s+(shouldn'?t|should\s+not)\s+have",
    r"\bdo\s+not\s+use\b",
    r"\bwe\s+don'?t\s+use\b",
    r"\b(you'?re|you\s+are)\s+(still\s+)?not\s+(following|aligned)\b",
    r"\bnot\s+following\s+(the\s+)?(project'?s?\s+)?(methodology|convention|AGENTS\.md|CLAUDE\.md)\b",
    r"\byou\s+keep\s+making\s+the\s+same\s+mistake\b",
    r"\bmistak(?:e|ing)\b.{0,40}\bfor\b",
]
# Fixed value: a line that is nothing but a refusal (multi-line mode).
CORRECTION_LINE = r"^(no|nope|wrong|incorrect)\s*[.!]?\s*$"
# Phrases that set rules.
INSTRUCTION = [
    r"\balways\s+(use|follow|run|start\s+with|ensure)",
    r"\bnever\s+(skip|push|commit|deploy|use)",
    r"\bmandatory\b",
    r"\bour\s+(workflow|process|methodology|convention|standard)",
    r"\bthe\s+rule\s+is\b",
    r"\bfor\s+this\s+(project|repo|team)\s+we\b",
    r"\bwe\s+(always|never|require|must)\b",
    r"\bbefore\s+(implementing|proceeding|starting\s+any)",
]
# Templates that appear under the user's role but were not typed.
BOILERPLATE_PREFIXES = [
    "Briefly inform the user about the task result and perform any follow-up actions",
    "The beginning of the above subagent result is already visible to the user.",
]
BOILERPLATE_TAG = r"^\s*<(system_reminder|attached_files|system_notification|mcp_server_catalog|user_info)\b"
# Broad cues of a possible correction.
LOOSE_CUES = [
    r"\bwrong\b",
    r"\bincorrect(ly)?\b",
    r"\bnot\s+(correct|right|following|aligned|what)\b",
    r"\bshould\s+(have|be|not)\b",
    r"\bdon'?t\s+(do|use)\b",
    r"\bdo\s+not\s+(use|do)\b",
    r"\bwe\s+don'?t\b",
    r"\bnever\s+use\b",
    r"\bstill\s+not\b",
    r"\bkeep\s+\w+ing\b",
    r"\bmistak(e|ing)\b",
    r"\bmisunderstood\b",
    r"\bmisread\b",
    r"\brevert\b",
    r"\bundo\b",
    r"\bwhy\s+did\s+you\b",
    r"\bwhy\s+(is|does|didn'?t)\b",
    r"\bthat'?s\s+not\b",
    r"\bnot\s+what\s+i\b",
    r"\bconfus",
    r"\bforgot\b",
    r"\byou\s+missed\b",
    r"\bwithout\s+permission\b",
    r"\bunauthorized\b",
    r"\bagain,?\s+you\b",
    r"\bnevermind\b|\bnever\s?mind\b",
    r"\bstop\b",
]
TRIVIAL_ACK = r"^(ok|okay|yes|no|sure|thanks|thank you|thx|got it|sounds good|perfect|great|nevermind|never mind|continue|proceed|go ahead|carry on|do it|please continue|lgtm|ack)[.!]?$"
BARE_URL = r"^https?://\S+$"
# Statements that age fast. The two with a lookahead are kept apart from the rest.
EPHEMERAL = [
    r"assistant (?:is |was )(?:creating|implementing|investigating|executing|analyzing|building|running|writing|checking|reviewing|debugging|fixing|updating|generating|pushing|working|deploying|refactoring|processing)",
    r"assistant (?:committed|pushed|created|completed|finished|deployed|started|moved|extracted|fixed|updated|added|applied|removed|replaced|refactored|identified|examined|verified|confirmed|addressed|resolved|rebased|cherry-picked|squashed|amended)",
    r"user is (?:working on|fixing|reviewing|investigating|performing|checking)",
    r"all \d+ (?:test|spec|job|resource)s? (?:pass|succeed|complet)",
    r"ci (?:pipeline|build|image|job|status)",
    r"build (?:passed|failed|succeeded|completed|in progress)",
    r"pipeline (?:status|build|jobs?|completed|passed|failed)",
    r"(?:lint|unit|integration|e2e) (?:test|job|check)s? (?:passed|failed|succeeded|completed)",
    r"image (?:built|pushed|deployed|published|tagged|is in)",
    r"pod (?:entered|crashed|restarted|is in|has status)",
    r"deployed to|deploying to|rollout",
    r"commit(?:ted|s?) (?:changes|work|fix|update)",
]
EPHEMERAL_REQUEST = [
    r"user requested (?!.*(?:always|never|mandatory|convention))",
    r"user instructed (?!.*(?:always|never|mandatory|convention))",
]
# Statements about one moment.
SNAPSHOT = [
    r"(?:running|using|deployed) (?:the |)(?:pr-\d+|sha256|v\d+|commit|version|build|image)",
    r"currently (?:running|deployed|using|in)",
    r"(?:ready|waiting) for ",
    r"(?:in progress|not started|not yet (?:started|complete))",
]
# Statements worth keeping.
VALUABLE = [
    r"\b(?:always|never|must|mandatory|convention|standard)\b",
    r"\b(?:pattern|anti-?pattern|best practice|lesson)\b",
    r"\b(?:architecture|design decision|trade-?off)\b",
    r"\b(?:bug|root cause|fix|regression)\b.*\b(?:because|due to|caused by)\b",
    r"\b(?:fedramp|nist|compliance|control)\b.*\b(?:require|mandate|verify)\b",
    r"\b(?:adr|dd)-\d+\b",
]
# Entity shapes, in the order in which they are listed.
ENTITIES = [
    r"\b[A-Z][a-z]+(?:[A-Z][a-z]*)+\b",
    r"\b[A-Z][A-Z0-9_]{2,}\b",
    r"\b(?:[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})\b",
]
# Keyword and topic, in the order in which topics are listed.
TOPICS = {
    "contradiction resolution": "contradiction-resolution",
    "contradiction-resolution": "contradiction-resolution",
    "cocoindex": "cocoindex",
    "retain": "retain",
    "mental model": "mental-models",
    "mental models": "mental-models",
    "tagging": "tagging",
    "tag-scoped": "tagging",
    "launchd": "launchd",
    "correction gate": "correction-gate",
    "correction detection": "correction-gate",
    "watermark": "watermark",
    "hindsight": "hindsight",
    "vertex ai": "vertex-ai",
    "haiku": "haiku",
    "sonnet": "sonnet",
    "recall": "recall",
    "project scoping": "project-scoping",
}
# Salience words.
HIGH_SALIENCE = ["mandatory", "always", "never", "must", "critical", "required", "breaking", "regression", "outage", "production"]
LOW_SALIENCE = ["maybe", "perhaps", "might", "could", "someday", "eventually"]
# Server naming variants.
SCOPE_SUFFIX = r"::mcpScope:.*$"
PROJECT_PREFIX = r"^(project-\d+-)?[a-z0-9]+(-v[\d.]+)?-(?=hindsight|cocoindex)"
RECALL_REQUEST = r"\b(recall|memory|hindsight|remember)\b"
# Tools that change things, and tools that look around.
PRODUCTIVE_TOOLS = ["Shell", "Write", "StrReplace", "EditNotebook", "Delete"]
EXPLORATION_TOOLS = ["Read", "Grep", "Glob", "SemanticSearch", "Task", "WebSearch"]
# Session sizes in tokens, below which a session is trivial, small, medium.
BUCKETS = [("trivial", 5000), ("small", 15000), ("medium", 100000)]


def any_of(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)

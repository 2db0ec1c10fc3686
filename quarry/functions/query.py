"""Column functions that analyse a question: its type, symbols, actions and expansions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import words

#: Patterns of each query type, in order of precedence (fixed values).
TYPE_PATTERNS = {
    "DEFINITION": [r"what\s+is", "define", r"class\s+\w+", r"interface\s+\w+"],
    "IMPLEMENTATION": [r"how\s+does", r"how\s+to", "implementation", "works?", "process"],
    "USAGE_EXAMPLES": ["example", "usage", r"how\s+to\s+use", "call", "invoke"],
    "ERROR_CONTEXT": ["error", "bug", "issue", "problem", "fail", "exception"],
    "EXPLORATION": ["related", "similar", "like", "connected", "around"],
}
#: Words that are no symbols (fixed values).
NO_SYMBOLS = ["the", "and", "for", "are", "with", "this", "that", "from", "they", "have", "been"]
#: Words that name each action (fixed values).
ACTIONS = {
    "create": ["create", "add", "implement", "build", "make", "generate"],
    "modify": ["modify", "change", "update", "edit", "alter", "refactor"],
    "debug": ["debug", "fix", "error", "bug", "issue", "problem"],
    "analyze": ["analyze", "understand", "explain", "how", "what", "why"],
    "test": ["test", "testing", "unit test", "integration"],
    "optimize": ["optimize", "performance", "speed", "memory", "efficient"],
}
#: Words left out of expansions (fixed values).
BROADER_STOPS = ["how", "does", "what", "the", "and", "with", "this"]
EXPANSION_STOPS = ["how", "what", "where", "when", "does", "the", "and", "with", "this", "that"]
#: Factors and caps of the expansion levels: tokens, results, most tokens (fixed values).
EXPANSION = {"conservative": (1.5, 1.5, 16000), "moderate": (2.0, 2.0, 24000), "aggressive": (3.0, 2.5, 32000)}
#: A token for symbol tests: letters, digits and underscores, perhaps called.
TOKEN = r"[\p{L}\p{N}_]+(?:\(\))?"


def bounded(pattern: str) -> str:
    """``pattern`` between characters that are no letters, digits or underscores (ASCII)."""
    return rf"(?:^|[^a-z0-9_])(?:{pattern})(?:$|[^a-z0-9_])"


def type_scores(query: Column) -> dict[str, Column]:
    """For each type the number of its patterns that occur."""
    low = F.lower(query)
    return {kind: sum((F.when(low.rlike(bounded(p)), 1).otherwise(0) for p in patterns), F.lit(0)) for kind, patterns in TYPE_PATTERNS.items()}


def query_type(query: Column) -> Column:
    """The type with most patterns (the first at ties); IMPLEMENTATION if none, SYMBOL_LOOKUP up to three words."""
    scores = type_scores(query)
    best = F.greatest(*scores.values())
    chosen = F.when(best == 0, "IMPLEMENTATION")
    for kind, score in scores.items():
        chosen = chosen.when(score == best, kind)
    return F.when(F.size(words(query)) <= 3, "SYMBOL_LOOKUP").otherwise(chosen)


def symbols(query: Column) -> Column:
    """Distinct identifiers of more than two characters, in order of first occurrence."""
    names = F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit(TOKEN), 0)
    fits = lambda s: s.rlike(r"^(?:[A-Z][a-zA-Z0-9]*|[a-z_][a-z0-9_]*[a-z0-9]|[a-zA-Z_][a-zA-Z0-9_]*\(\))$")
    return F.array_distinct(F.filter(names, lambda s: fits(s) & (F.length(s) > 2) & ~F.lower(s).isin(NO_SYMBOLS)))


def confidence(query: Column) -> Column:
    best = F.greatest(*type_scores(query).values())
    score = F.lit(0.5) + F.when(best > 0, 0.2).otherwise(0.0) + F.when(F.size(symbols(query)) > 0, 0.2).otherwise(0.0) + F.when(F.size(words(query)) <= 5, 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), score)


def contains_any(text: Column, terms: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t))


def actions(query: Column) -> Column:
    """Names of the actions whose words occur, in declaration order."""
    low = F.lower(query)
    found = F.array(*[F.when(contains_any(low, terms), name) for name, terms in ACTIONS.items()])
    return F.filter(found, lambda x: x.isNotNull())


def extensions(query: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit(r"\.([a-zA-Z0-9]+)"), 1)


def case_symbols(query: Column) -> Column:
    """Camel, snake and Pascal case identifiers, sorted."""
    names = F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit(r"[\p{L}\p{N}_]+"), 0)
    return F.array_sort(F.array_distinct(F.filter(names, lambda s: s.rlike(r"^(?:[a-z][a-zA-Z0-9_]*[A-Z][a-zA-Z0-9_]*|[a-zA-Z][a-zA-Z0-9_]*_[a-zA-Z0-9_]+|[A-Z][a-zA-Z0-9_]*)$"))))


def signature(query: Column, project: Column) -> Column:
    """First sixteen hex digits of the MD5 of question and project."""
    return F.substring(F.md5(F.concat(query, F.lit(":"), F.coalesce(project, F.lit(""))).cast("binary")), 1, 16)


def broader_queries(query: Column) -> Column:
    """Two follow-up queries for each of the first two longer words, by the question's type; none for other types."""
    kept = F.slice(F.filter(words(query), lambda w: (F.length(w) > 3) & ~w.isin(BROADER_STOPS)), 1, 2)
    both = lambda a, b: F.flatten(F.transform(kept, lambda w: F.array(a(w), b(w))))
    how = both(lambda w: F.concat(w, F.lit(" implementation")), lambda w: F.concat(w, F.lit(" process")))
    use = both(lambda w: F.concat(F.lit("using "), w), lambda w: F.concat(w, F.lit(" example")))
    kind = query_type(query)
    return F.when(kind == "IMPLEMENTATION", how).when(kind == "USAGE_EXAMPLES", use).otherwise(F.array().cast("array<string>"))


def expansion_queries(query: Column) -> Column:
    """At most four: implementation and usage of the first three longer words, their pair, and error or test prompts."""
    kept = F.slice(F.filter(words(query), lambda w: (F.length(w) > 3) & ~w.isin(EXPANSION_STOPS)), 1, 3)
    parts = F.flatten(F.transform(kept, lambda w: F.array(F.concat(w, F.lit(" implementation")), F.concat(w, F.lit(" usage")))))
    pair = F.when(F.size(kept) >= 2, F.array(F.concat_ws(" ", F.slice(kept, 1, 2)))).otherwise(F.array().cast("array<string>"))
    low = F.lower(query)
    prompt = lambda on, text: F.when(on, F.array(F.lit(text))).otherwise(F.array().cast("array<string>"))
    more = F.concat(prompt(F.contains(low, F.lit("error")) | F.contains(low, F.lit("bug")), "error handling debugging"), prompt(F.contains(low, F.lit("test")), "test cases examples"))
    return F.slice(F.concat(parts, pair, more), 1, 4)


def expansion_parameters(tokens: int, top_k: int, level: str) -> tuple[int, int]:
    """Token budget and number of results of an expansion level; unknown levels count as moderate."""
    by_tokens, by_results, cap = EXPANSION.get(level, EXPANSION["moderate"])
    return min(int(tokens * by_tokens), cap), int(top_k * by_results)


def expansion_columns(tokens: Column, top_k: Column, level: Column) -> Column:
    """The same for rows: a struct of max_tokens and top_k."""
    pick = lambda k: F.when(level == "conservative", F.lit(EXPANSION["conservative"][k])).when(level == "aggressive", F.lit(EXPANSION["aggressive"][k])).otherwise(F.lit(EXPANSION["moderate"][k]))
    budget = F.least(F.floor(tokens * pick(0)), pick(2)).cast("long")
    return F.struct(budget.alias("max_tokens"), F.floor(top_k * pick(1)).cast("long").alias("top_k"))


def direct_file_question(query: Column) -> Column:
    """Names a source file and asks for its content."""
    return contains_any(query, [".py", ".js", ".ts", ".java", ".kt"]) & contains_any(F.lower(query), ["content", "file"])

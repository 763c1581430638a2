"""Text and path expressions: tokenizers, credits, hashes, globs, roles. All are built-in column functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the query language.
STOP_WORDS = tuple(
    "the and for with from into when where which that this than then also only not are was were has have been will should can its all any each some such via per after before over under "
    "code generated given retrieve relevant "
    "add adds added remove removes removed fix fixes fixed use uses used make makes update updates updated change changes changed allow allows avoid avoids ensure ensures keep keeps rename renames support supports implement implements improve improves prevent prevents replace replaces refactor simplify".split()
)
COMMON_NAMES = tuple("default from into drop clone hash next main test tests build load read write init name path call with apply parse find self mod lib index none some true false type impl args data item node text value values error result state config output".split())
QUESTION_STOP_WORDS = tuple(
    "a after also an and any are as at be been before by can do does each every for from has have how if in into is it its of on once one only or per so than that the then there this through to was were what when which while whose with "
    "between binary call called calls chain concrete containing contains down end ends function functions implementing intermediate invoking lead leads lie links list method methods name next order ordered passed path reach reaches sequence start starting step steps them trace way".split()
)
WHY_STOP_WORDS = tuple("because should would could which where there their these those before after being using commit commits change changed reason happened behind decide".split())
MAX_TERMS, MAX_SYMBOLS = 24, 12
SNIPPET_BYTES = 400
SOURCE_PRIOR = 0.004


def split_words(text: Column) -> Column:
    """Runs of letters, digits, '_' and '#', in order."""
    return F.filter(F.split(text, r"[^A-Za-z0-9_#]+"), lambda w: w != "")


def split_identifier(name: Column) -> Column:
    """Parts of an identifier at '_', lower-to-upper changes, ends of acronyms and letter/digit changes."""
    marked = F.regexp_replace(name, r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|_+", "|")
    return F.filter(F.split(marked, r"\|"), lambda w: w != "")


def query_terms(text: Column) -> Column:
    """Lower-cased words and their parts, once each, no numbers; of more than 24 the longest, in first-seen order."""
    words = split_words(text)
    parts = F.flatten(F.transform(words, lambda w: F.concat(F.array(w), split_identifier(w))))
    terms = F.array_distinct(F.filter(F.transform(parts, F.lower), lambda w: ~w.rlike("^[0-9]+$")))
    ranked = F.array_sort(F.transform(terms, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w"))))
    kept = F.array_sort(F.transform(F.slice(ranked, 1, MAX_TERMS), lambda s: F.struct(s["i"].alias("i"), s["w"].alias("w"))))
    return F.transform(kept, lambda s: s["w"])


def symbol_terms(text: Column) -> Column:
    """Whole lower-cased words, longest first, at most 12; equal lengths in first-seen order."""
    words = F.array_distinct(F.transform(split_words(text), F.lower))
    ranked = F.array_sort(F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w"))))
    return F.transform(F.slice(ranked, 1, MAX_SYMBOLS), lambda s: s["w"])


def question_terms(text: Column) -> Column:
    stop = F.array(*[F.lit(w) for w in QUESTION_STOP_WORDS])
    return F.filter(query_terms(text), lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w))


def credits(line: Column, term: str) -> Column:
    """Whether a line holds a term: five or more characters anywhere; fewer only as a word, which an upper-case letter may end."""
    if len(term) >= 5:
        return F.contains(F.lower(line), F.lit(term.lower()))
    return line.rlike(rf"(?<![A-Za-z0-9])(?i:{re.escape(term)})(?=[^A-Za-z0-9]|[A-Z]|$)")


def whole_word_at(text: Column, needles: list[str]) -> Column:
    """Index of the first needle that stands in the text as a whole identifier; null if none does."""
    out = F.lit(None).cast("int")
    for i, n in reversed(list(enumerate(needles))):
        out = F.when(text.rlike(rf"(?<!\w){re.escape(n)}(?!\w)"), F.lit(i)).otherwise(out)
    return out


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def vector_key(digest: Column, path: Column | None = None) -> Column:
    return digest if path is None else F.concat_ws("\u001f", digest, path)


def head_bytes(text: Column, most: int) -> Column:
    """At most `most` bytes of UTF-8, cut at a character."""
    raw = text.cast("binary")
    inside = lambda n: F.hex(F.substring(raw, n + 1, 1)).rlike("^[89AB]")  # noqa: E731 - byte n + 1 goes on with a character
    cut = F.when(~inside(most), most).when(~inside(most - 1), most - 1).when(~inside(most - 2), most - 2).otherwise(most - 3)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.substring(raw, F.lit(1), cut).cast("string"))


def snippet(text: Column, most: int = SNIPPET_BYTES) -> Column:
    """At most `most` bytes of UTF-8, cut at a character, with an ellipsis if anything was cut."""
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(head_bytes(text, most), F.lit("…")))


def percent(x: Column) -> Column:
    """0..1 as a rounded percentage; not a number counts as a half."""
    return F.round(F.least(F.greatest(F.when(F.isnan(x), F.lit(0.5)).otherwise(x), F.lit(0.0)), F.lit(1.0)) * 100).cast("int")


def capped_logit(p: Column, cap: float = 3.0) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.least(F.greatest(F.log(q / (1 - q)), F.lit(-cap)), F.lit(cap))


def relevance_factor(score: Column, floor: float) -> Column:
    return floor + (1 - floor) * score


def rerank_document(path: Column, code: Column, most: int = 4096) -> Column:
    return F.concat(path, F.lit("\n"), head_bytes(code, most))


def fill(template: str, **values: Column) -> Column:
    out = F.lit(template)
    for name, v in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), v)
    return out


def redact(text: Column) -> Column:
    """Values of secret-like keys in addresses and JSON become ***."""
    url = F.regexp_replace(text, r"(?i)([?&](?:key|token|secret|password)=)[^&#\s]*", "$1***")
    return F.regexp_replace(url, r'(?i)("(?:key|token|secret|password)"\s*:\s*)"[^"]*"', '$1"***"')


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def normalise_path(path: Column, root: str = "") -> Column:
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(F.startswith(p, F.lit(root)), F.substring(p, len(root) + 1, 1 << 30)).otherwise(p) if root else p


def glob_regex(pattern: str) -> str:
    """'*' within a component, '**' over components, '?', '[...]'; absolute, empty, '..' and backslash patterns are refused."""
    if not pattern or pattern.startswith("/") or "\\" in pattern or ".." in pattern.split("/"):
        raise ValueError(f"bad pattern {pattern!r}")
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
            continue
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end + 1
            continue
        out += "[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)
        i += 1
    return f"^{out}$"


def matches_any(path: Column, patterns: list[str]) -> Column:
    return path.rlike("|".join(glob_regex(p) for p in patterns)) if patterns else F.lit(False)


def source_role(path: Column) -> Column:
    """One of seven roles; the first rule that fits decides."""
    rules = (
        ("documentation", r"(?i)\.(md|markdown|rst|adoc)$"), ("generated", r"(?i)(^|/)(generated|gen|dist|build|target)/|\.(min\.js|pb\.go|g\.cs)$"),
        ("test", r"(?i)(^|/)(tests?|spec|__tests__)/|(_test|\.test|\.spec|_spec)\.[^/]+$|(^|/)test_[^/]+$"), ("benchmark", r"(?i)(^|/)(bench|benches|benchmarks?)/"),
        ("example", r"(?i)(^|/)(examples?|samples?|demo)/"), ("documentation", r"(?i)(^|/)docs?/"), ("configuration", r"(?i)\.(toml|ya?ml|json|ini|cfg|conf)$"),
    )
    out = F.lit("source")
    for role, rule in reversed(rules):
        out = F.when(path.rlike(rule), role).otherwise(out)
    return out


def role_prior(role: Column) -> Column:
    return F.when(role == "source", SOURCE_PRIOR).otherwise(0.0)


def excerpt(code: Column, lines: int, width: int = 500) -> Column:
    """The first lines, each cut at `width` characters with an ellipsis."""
    cut = lambda x: F.when(F.length(x) > width, F.concat(F.substring(x, 1, width), F.lit("…"))).otherwise(x)
    return F.array_join(F.transform(F.slice(F.split(code, "\n"), 1, lines), cut), "\n")


def symbol_queries(text: Column) -> Column:
    """term# for each query term, before it the singular of plurals over four bytes; repeats in a row once, at most eight."""
    plural = lambda w: F.endswith(w, F.lit("s")) & (F.octet_length(w) > 4)
    both = F.flatten(F.transform(query_terms(text), lambda w: F.when(plural(w), F.array(F.concat(F.substring(w, F.lit(1), F.length(w) - 1), F.lit("#")), F.concat(w, F.lit("#")))).otherwise(F.array(F.concat(w, F.lit("#"))))))
    # as the item of an array the list has a name; in the inner function itself it would be made anew for each of its words
    return F.get(F.transform(F.array(both), lambda b: F.slice(F.filter(b, lambda w, i: (i == 0) | (w != F.get(b, i - 1))), 1, 8)), 0)


def code_spans(text: Column) -> Column:
    """What stands between back-ticks, in order."""
    return F.regexp_extract_all(text, F.lit("`([^`]+)`"), F.lit(1))


def code_names(text: Column) -> Column:
    """Code spans that are names: identifiers joined by '::' or '.', an ending () left out."""
    bare = F.transform(code_spans(text), lambda s: F.regexp_replace(s, r"\(\)$", ""))
    return F.filter(bare, lambda s: s.rlike(r"^[A-Za-z_][A-Za-z0-9_]*(?:(?:::|\.)[A-Za-z_][A-Za-z0-9_]*)*$"))


def literal_needles(text: Column, least: int = 4, most: int = 8) -> Column:
    """Last segments of the names in code spans, once each."""
    last = F.transform(code_names(text), lambda s: F.regexp_extract(s, r"([A-Za-z0-9_]+)$", 1))
    return F.slice(F.array_distinct(F.filter(last, lambda s: F.length(s) >= least)), 1, most)


def why_tokens(text: Column, most: int = 8) -> Column:
    """Names in back-ticks, then lower-cased words outside them of six letters or more that are no stop words; no word twice in any case."""
    outside = F.array_join(F.filter(F.split(text, "`"), lambda s, i: i % 2 == 0), " ")
    stop = F.array(*[F.lit(w) for w in WHY_STOP_WORDS])
    words = F.filter(F.transform(F.split(outside, "[^A-Za-z]+"), F.lower), lambda w: (F.length(w) >= 6) & ~F.array_contains(stop, w))
    names = code_names(text)
    fresh = F.array_distinct(F.filter(words, lambda w: ~F.array_contains(F.transform(names, F.lower), w)))
    return F.slice(F.concat(names, fresh), 1, most)


# Words that declare the name after them.
DECLARING = ("fn", "trait", "struct", "enum", "impl", "class", "interface", "type", "mod", "def", "func", "union", "record", "protocol", "function", "object", "delegate")


def declares(line: Column, name: str) -> Column:
    """Whether a line declares a name: a declaring word right before its first whole occurrence, `impl .. for`, a Go receiver, or a C# delegate; never a comment."""
    comment = line.rlike(r"^\s*(?://|/\*|\*|#|--)")
    here = line.rlike(rf"(?s)(?<!\w){re.escape(name)}(?!\w)")
    before = F.regexp_extract(line, rf"(?s)^(.*?)(?<!\w){re.escape(name)}(?!\w)", 1)
    trimmed = F.trim(before)
    receiver = F.endswith(trimmed, F.lit(")")) & trimmed.rlike(r"^func ?\(")
    word = before.rlike(rf"(?:^|\W)(?:{'|'.join(DECLARING)})\W*$")
    implements = before.rlike(r"(?:^|\W)for\W*$") & before.rlike(r"(?:^|\W)impl(?:\W|$)")
    delegate = before.rlike(r"(?:^|\W)delegate\W") & ~F.contains(before, F.lit("("))
    return here & ~comment & F.when(receiver, F.length(trimmed) - F.length(F.replace(trimmed, F.lit("("), F.lit(""))) == 1).otherwise(word | implements | delegate)


def module_path(path: Column) -> Column:
    """Segments of a file as a module: without src, extension, and mod, lib or main at the end."""
    parts = F.filter(F.split(F.regexp_replace(path, r"\.[^./]+$", ""), "/"), lambda s: s != "src")
    return F.when(F.element_at(parts, -1).isin("mod", "lib", "main"), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def specificity(pattern: Column) -> Column:
    """(components with wildcards, '**' components, literal characters with a minus): less is more specific."""
    parts = F.split(pattern, "/")
    literal = F.length(F.regexp_replace(pattern, r"[*?\[\]]", ""))
    return F.struct(F.size(F.filter(parts, lambda p: p.rlike(r"[*?\[]"))).cast("long").alias("wild"), F.size(F.filter(parts, lambda p: p == "**")).cast("long").alias("recursive"), (-literal).cast("long").alias("literal"))


def node_card(node: Column, how: Column, potential: Column, depth: Column, most: int = 160) -> Column:
    """node | how | p0.50 d2 in at most `most` characters; a long node loses its start to a '~'."""
    tail = F.concat(F.lit(" | "), how, F.format_string(" | p%.2f d%d", potential, depth))
    room = F.lit(most) - F.length(tail)
    return F.concat(F.when(F.length(node) <= room, node).otherwise(F.concat(F.lit("~"), F.right(node, room - 1))), tail)


def node_id(kind: Column, path: Column, name: Column) -> Column:
    """kind:path#name, with '%', ':' and '#' of the parts escaped."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit(":"), F.lit("%3A")), F.lit("#"), F.lit("%23"))
    return F.concat(safe(kind), F.lit(":"), safe(path), F.when(name.isNotNull() & (name != ""), F.concat(F.lit("#"), safe(name))).otherwise(""))


def node_parts(node: Column) -> Column:
    """(kind, path, name) of a node id; null if it is none."""
    plain = lambda c: F.replace(F.replace(F.replace(c, F.lit("%23"), F.lit("#")), F.lit("%3A"), F.lit(":")), F.lit("%25"), F.lit("%"))
    shape = r"^([^:#]+):([^:#]+)(?:#([^:#]+))?$"
    parts = F.struct(*[plain(F.regexp_extract(node, shape, i)).alias(n) for i, n in ((1, "kind"), (2, "path"), (3, "name"))])
    return F.when(node.rlike(shape), parts)


def usable_term(term: Column) -> Column:
    return (F.length(term) >= 3) & ~F.lower(term).isin(*STOP_WORDS)


def usable_name(name: Column, least: int = 4) -> Column:
    """A name that is long enough and does not occur everywhere."""
    return (F.octet_length(name) >= least) & ~F.lower(name).isin(*COMMON_NAMES)

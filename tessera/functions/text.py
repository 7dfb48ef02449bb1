"""Column expressions over text: tokens, hashes, names, derived text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words of each part, which differ.
SPARSE_STOP = "the and for with that this from your you are can use using via into over all any a an of to in on is it my me do i".split()
RERANK_STOP = [*SPARSE_STOP, "want", "need"]
KEYWORD_STOP = "the and for with that this from your you are can use using via into over all any mcp server tool tools api data".split()
# Topics that say nothing about a repository.
GENERIC_TOPICS = ["mcp", "mcp-server", "mcp-servers", "model-context-protocol", "modelcontextprotocol", "ai", "llm", "claude", "anthropic"]

FNV_START, FNV_PRIME, FNV_SIZE = 2166136261, 16777619, 4294967296


def trim(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank(c: Column) -> Column:
    return trim(c) == ""


def first_of(*columns: Column) -> Column:
    """The first that is not blank, else ''."""
    out = F.lit("")
    for c in reversed(columns):
        out = F.when(~blank(c), c).otherwise(out)
    return out


def without(words: Column, stop: list[str]) -> Column:
    return F.filter(words, lambda w: ~w.isin(*stop))


def tokens(c: Column, stop: list[str] | None = None) -> Column:
    """Lower-cased runs of letters and digits, with repeats."""
    found = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return without(found, stop) if stop else found


def term_set(c: Column) -> Column:
    """Distinct tokens without the stop words of reranking."""
    return F.array_distinct(tokens(c, RERANK_STOP))


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes, as a bigint; its products stay below 2^57."""
    start = F.lit(FNV_START).cast("bigint")
    return F.when(c == "", start).otherwise(F.aggregate(F.split(c, ""), start, _character))


def _character(h: Column, ch: Column) -> Column:
    """The hash after the one to four bytes of a character."""
    point = F.ascii(ch).cast("bigint")

    def after(h: Column, size: int) -> Column:
        mark = F.lit((0xC0, 0xE0, 0xF0)[size - 2]).cast("bigint")
        h = _byte(h, F.shiftright(point, 6 * (size - 1)).bitwiseOR(mark))
        for k in range(size - 2, -1, -1):
            h = _byte(h, F.shiftright(point, 6 * k).bitwiseAND(63).bitwiseOR(F.lit(0x80).cast("bigint")))
        return h

    return F.when(point < 0x80, _byte(h, point)).when(point < 0x800, after(h, 2)).when(point < 0x10000, after(h, 3)).otherwise(after(h, 4))


def _byte(h: Column, byte: Column) -> Column:
    return (h.bitwiseXOR(byte) * FNV_PRIME) % FNV_SIZE


def display_name(title: Column, name: Column) -> Column:
    return F.when(~blank(title), title).otherwise(name)


def humanize(c: Column) -> Column:
    """``getUserById`` and ``get_user.by-id`` as ``get user by id``."""
    out = F.regexp_replace(c, r"[_\-./]+", " ")
    out = F.regexp_replace(out, r"([a-z0-9])([A-Z])", "$1 $2")
    out = F.regexp_replace(out, r"[^a-zA-Z0-9 ]+", " ")
    return F.lower(F.trim(F.regexp_replace(out, r" +", " ")))


def first_sentence(c: Column) -> Column:
    """Up to the first of ``.!?`` or a line feed; a text that begins with one is left whole."""
    s = trim(c)
    return F.when(s.rlike(r"^[.!?\n]"), s).otherwise(trim(F.regexp_extract(s, r"^[^.!?\n]*", 0)))


def keywords(c: Column, most: int = 8) -> Column:
    words = F.split(F.regexp_replace(F.lower(c), r"[^a-zA-Z0-9 ]+", " "), r"\s+")
    return F.slice(F.sort_array(F.array_distinct(without(F.filter(words, lambda w: F.length(w) >= 4), KEYWORD_STOP))), 1, most)


def ordered_set(c: Column) -> Column:
    """Trimmed, without blanks, each once, in the order of first appearance."""
    return F.array_distinct(F.filter(F.transform(c, trim), lambda x: x != ""))


def merged_categories(a: Column, b: Column) -> Column:
    return ordered_set(F.concat(a, b))


def useful_topics(c: Column) -> Column:
    return F.filter(c, lambda t: ~F.lower(t).isin(*GENERIC_TOPICS))


#: Removed from the front of a repository address, in this order, each once.
PREFIXES = ("git+https://", "git+http://", "https://", "http://", "ssh://", "git://")


def repository(c: Column) -> Column:
    """One form for all addresses of a repository."""
    out = F.lower(trim(c))
    for prefix in (*PREFIXES, "git@"):
        out = F.regexp_replace(out, rf"^\Q{prefix}\E", "")
    out = F.regexp_replace(out, r"^(.*?)github\.com:", "$1github.com/")
    out = F.regexp_replace(out, r"^www\.", "")
    out = F.regexp_replace(out, r"/$", "")
    return F.regexp_replace(out, r"\.git$", "")


def source_priority(c: Column) -> Column:
    return F.when(c == "registry", 3).when(c == "github", 2).when(c == "file", 1).otherwise(0)


def _lines(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*[trim(p) for p in parts]), lambda x: x != ""), "\n")


def _list(label: str, items: Column, between: str) -> Column:
    return F.when(F.size(items) > 0, F.concat(F.lit(label), F.array_join(items, between))).otherwise(F.lit(""))


def embedding_text(m) -> Column:
    """Text of a server point; ``m`` gives the columns of a catalogue row."""
    card = m("enrichment")
    body = F.when(~blank(card["summary"]), card["summary"]).otherwise(m("description"))
    names = F.transform(m("tools"), lambda t: t["name"])
    return _lines(
        m("title"), m("name"), body, _list("Can be used to: ", card["tasks"], "; "), _list("Related: ", card["synonyms"], ", "),
        _list("Categories: ", merged_categories(m("categories"), card["categories"]), ", "), _list("Tools: ", names, ", "),
    )


def tool_text(tool: Column, display: Column) -> Column:
    return _lines(tool["name"], tool["description"], F.concat(F.lit("From MCP: "), display))


def candidate_text(m) -> Column:
    """Everything that reranking matches a query's terms against."""
    card = m("enrichment")
    tools = F.flatten(F.transform(m("tools"), lambda t: F.array(t["name"], t["description"])))
    parts = F.array(m("title"), m("name"), m("description"), card["summary"], F.array_join(card["tasks"], "\n"), F.array_join(card["exampleQueries"], "\n"), F.array_join(card["synonyms"], " "), F.array_join(m("categories"), " "))
    return F.array_join(F.concat(parts, tools), "\n")

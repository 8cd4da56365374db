"""Text as columns: tokens, normal forms, keys, HTML, JSON repair. Everything is a ``Column -> Column`` function."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Unicode text processing strips it (Java's \\s is ASCII only).
WS = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{WS}]+|[{WS}]+$", "")


def words(c: Column) -> Column:
    """White-space separated words."""
    return F.regexp_extract_all(c, F.lit(f"[^{WS}]+"), F.lit(0))


def first_words(c: Column, n: int) -> Column:
    """The first ``n`` words: the pattern stops behind them, the rest of the text is not searched."""
    return words(F.regexp_extract(c, f"^(?:[{WS}]*+[^{WS}]++){{0,{n}}}+", 0))


def word_count(c: Column) -> Column:
    return F.size(words(c))


def tokens(c: Column) -> Column:
    """Letter runs of the lower-cased text; combining vowel signs separate them."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+"), F.lit(0))


def cache_text(c: Column) -> Column:
    """Normal form for cache keys: stripped, lower case, single spaces, then punctuation dropped (in that order)."""
    spaced = F.regexp_replace(F.lower(strip(c)), f"[{WS}]+", " ")
    return F.regexp_replace(spaced, rf"[^\p{{L}}\p{{N}}_{WS}\x{{0900}}-\x{{097F}}\x{{0980}}-\x{{09FF}}\x{{0B80}}-\x{{0BFF}}]", "")


def list_part(c: Column) -> Column:
    """A list as a key part: its members as text, sorted and joined by commas."""
    return F.array_join(F.sort_array(F.transform(c, lambda x: x.cast("string"))), ",")


def cache_key(call_type: Column, *parts: Column) -> Column:
    """``call_type:`` and 24 hex digits of SHA-256 over the call type and the parts, joined by bars.

    Wrap text parts in ``cache_text`` and lists in ``list_part``; other values are cast.
    """
    raw = F.concat_ws("|", call_type, *(p.cast("string") for p in parts))
    return F.concat(call_type, F.lit(":"), F.substring(F.sha2(raw, 256), 1, 24))


def content_hash(c: Column) -> Column:
    return F.md5(c)


HIDDEN_BLOCKS = ("script", "style", "nav", "footer", "header", "aside")


def html_to_text(html: Column) -> Column:
    """Text of a page: hidden blocks and tags become a blank, runs of two and more blanks one; entities stay."""
    blocks = F.regexp_replace(html, rf"(?is)<({'|'.join(HIDDEN_BLOCKS)})[^>]*>.*?</\1>", " ")
    plain = F.regexp_replace(blocks, "<[^>]+>", " ")
    return strip(F.regexp_replace(plain, f"[{WS}]{{2,}}", " "))


#: The content areas in order of preference, as tag, id and class.
CONTENT_AREAS = (("main", None, None), ("article", None, None), (None, "content", None), (None, None, "content"), (None, None, "scheme-detail"), ("body", None, None))
#: Elements without content, and elements whose content is no markup.
VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
RAW_TAGS = ("script", "style", "textarea", "title")
_INSIDE = r"""(?:[^'">]++|"[^"]*"|'[^']*')*+"""
#: A page in pieces that join to the page again: comments, raw elements whole, tags, text.
_PIECES = rf"(?is)<!--.*?(?:-->|\z)|<({'|'.join(RAW_TAGS)})(?=[\s/>]){_INSIDE}>.*?(?:</\1\s*>|\z)|</?[a-z]{_INSIDE}>|<[!?/][^>]*>|[^<]++|<"


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value in a start tag, without quotes; empty where there is none."""
    raw = F.regexp_extract(tag, rf"""(?is)^<[a-z][^\s/>]*(?:\s+[^\s=>"']+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"']+))?)*?\s+{name}\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", 1)
    return F.regexp_replace(raw, """^["']|["']$""", "")


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _tag(piece: Column) -> Column:
    """What a piece does: its length, the name it opens or closes, and which content areas it starts, if any."""
    opens, closes = piece.rlike("^<[A-Za-z]"), piece.rlike("^</[A-Za-z]")
    name = F.lower(F.regexp_extract(piece, r"^</?([A-Za-z][^\s/>]*)", 1))

    def starts(known: Column) -> Column:
        tests = []
        for tag, ident, cls in CONTENT_AREAS:
            test = known == tag if tag else _attribute(piece, "id") == ident if ident else F.array_contains(F.split(_attribute(piece, "class"), r"\s+"), cls)
            tests.append(test if tag else piece.rlike(rf"(?i)\s{'id' if ident else 'class'}\s*=") & test)
        return F.when(F.array_contains(F.array(*tests), True), F.array(*tests))

    def told(known: Column) -> Column:
        kept = opens & ~known.isin(*VOID_TAGS, *RAW_TAGS)
        return F.struct(F.char_length(piece).alias("size"), F.when(kept, known).alias("opens"), F.when(closes, known).alias("closes"), F.when(kept, starts(known)).alias("starts"))

    plain = F.struct(F.char_length(piece).alias("size"), F.lit(None).cast("string").alias("opens"), F.lit(None).cast("string").alias("closes"), F.lit(None).cast("array<boolean>").alias("starts"))
    return F.when(opens | closes, _let(name, told)).otherwise(plain)


def content_spans(html: Column) -> Column:
    """For each content area ``(start, depth, end)`` of the first element that is one: its inner HTML lies from ``start`` up to ``end``; -1 where there is none.

    A fold over the page's pieces with the stack of open elements: an end tag closes the nearest open element of its name and all in it, and is ignored where there is none; what is
    never closed ends with the page.
    """
    n = len(CONTENT_AREAS)
    none = F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("depth"), F.lit(-1).alias("end"))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("stack"), F.array(*[none] * n).alias("areas"))

    def step(s: Column, t: Column) -> Column:
        depth = F.size(s["stack"])
        back = F.array_position(F.reverse(s["stack"]), t["closes"]).cast("int")
        left = F.when(t["closes"].isNotNull() & (back > 0), depth - back)
        stack = F.when(t["opens"].isNotNull(), F.array_append(s["stack"], t["opens"])).when(left.isNotNull(), F.slice(s["stack"], F.lit(1), left)).otherwise(s["stack"])

        def area(a: Column, k: Column) -> Column:
            begins = (a["start"] < 0) & F.coalesce(F.get(t["starts"], k), F.lit(False))
            ends = (a["start"] >= 0) & (a["end"] < 0) & F.coalesce(a["depth"] > left, F.lit(False))
            return F.when(begins, F.struct((s["at"] + t["size"]).alias("start"), (depth + 1).alias("depth"), F.lit(-1).alias("end"))).when(ends, a.withField("end", s["at"])).otherwise(a)

        at = (s["at"] + t["size"]).alias("at")
        areas = F.when(left.isNull() & t["starts"].isNull(), s["areas"]).otherwise(F.transform(s["areas"], area))
        return F.when(t["opens"].isNull() & t["closes"].isNull(), s.withField("at", at)).otherwise(F.struct(at, stack.alias("stack"), areas.alias("areas")))

    pieces = F.transform(F.regexp_extract_all(html, F.lit(_PIECES), F.lit(0)), _tag)
    return F.aggregate(pieces, first, step, lambda s: F.transform(s["areas"], lambda a: F.when((a["start"] >= 0) & (a["end"] < 0), a.withField("end", s["at"])).otherwise(a)))


def content_area(html: Column, least: int = 500) -> Column:
    """The inner HTML of the first content area that has more than ``least`` characters of it, else the whole page.

    It is cut from the page as it is written; a browser's own repairs of broken markup are not made.
    """
    spans = F.filter(content_spans(html), lambda a: (a["start"] >= 0) & (a["end"] - a["start"] > least))
    return _let(F.get(spans, F.lit(0)), lambda best: F.when(best.isNotNull(), F.substring(html, best["start"] + 1, best["end"] - best["start"])).otherwise(html))


def page_text(html: Column, most: int = 20_000) -> Column:
    """What is kept of a page: the text of its content area, cut to ``most`` characters."""
    return kept_text(content_area(html), most)


def kept_text(area: Column, most: int = 20_000) -> Column:
    return F.left(html_to_text(area), F.lit(most))


#: Milliseconds that slow sites get.
SLOW_SITES = {
    "nabard.org": 45000,
    "nsdl.co.in": 40000,
    "indiapost.gov.in": 40000,
    "wcd.nic.in": 35000,
    "nrega.nic.in": 35000,
    "nsap.nic.in": 35000,
    "yet.nta.ac.in": 35000,
    "mohua.gov.in": 35000,
    "mnre.gov.in": 35000,
}


def fetch_timeout(url: Column, sites: dict[str, int] | None = None, default: int = 25000) -> Column:
    """Timeout of a URL's site: the host or a parent domain of it, without a leading ``www.``."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")
    sites = SLOW_SITES if sites is None else sites
    hits = [F.when((host == d) | F.endswith(host, F.lit("." + d)), F.lit(ms)) for d, ms in sites.items()]
    return F.coalesce(*hits, F.lit(default))


def first_match(text: Column, pattern: str, most: int = 120) -> Column:
    """The first match, cut to ``most`` characters; null without a match."""
    return F.when(F.regexp_like(text, F.lit(pattern)), F.substring(F.regexp_extract(text, pattern, 0), 1, most))


def quoted(word: str) -> str:
    """A word as a regular expression for Java."""
    return "".join("\\" + c if c in r"\^$.|?*+()[]{}-" else c for c in word)


def contains_any(text: Column, needles) -> Column:
    return F.regexp_like(text, F.lit("|".join(quoted(n) for n in sorted(needles))))


def is_one_of(text: Column, values) -> Column:
    """Exact membership after strip and lower case."""
    return F.lower(strip(text)).isin(*sorted(values))


def without_prefix(text: Column, prefix: str = "whatsapp:") -> Column:
    t = strip(text)
    return F.when(F.startswith(t, F.lit(prefix)), strip(F.substring(t, F.lit(len(prefix) + 1), F.length(t)))).otherwise(t)


def light_markup(text: Column) -> Column:
    """``_x_`` as emphasis, line ends as breaks."""
    return F.replace(F.regexp_replace(text, r"_(.+?)_", "<em>$1</em>"), F.lit("\n"), F.lit("<br>"))


def latin1_safe(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x{0}-\x{FF}]", "?")


def snake_words(name: Column) -> Column:
    return F.replace(name, F.lit("_"), F.lit(" "))


def each_translated(items: Column, translate, bar: str = " | ") -> Column:
    """A list through a text translator in one call: joined, translated, split; the original if the count changed."""
    out = F.split(translate(F.array_join(items, bar)), r"\s*\|\s*")
    return F.when(F.size(items) == 0, items).when(F.size(out) == F.size(items), out).otherwise(items)


def localised(table: dict[str, dict[str, str]], key: Column, lang: Column, default: str = "en", default_key: str | None = None) -> Column:
    """A message by key and language; unknown languages fall back to ``default``, unknown keys to ``default_key``."""
    flat = F.create_map(*(F.lit(x) for k, by in table.items() for lg, text in by.items() for x in (f"{k}\0{lg}", text)))

    def at(k: Column, lg: Column) -> Column:
        return F.element_at(flat, F.concat(k, F.lit("\0"), lg))

    k = key if default_key is None else F.when(key.isin(*table), key).otherwise(F.lit(default_key))
    return F.coalesce(at(k, lang), at(k, F.lit(default)), F.lit(""))


# --- JSON repair ---------------------------------------------------------------------------------


def json_body(raw: Column) -> Column:
    """Reasoning blocks and code fences removed, cut from the first opening to the last closing brace."""
    s = strip(F.regexp_replace(raw, r"(?s)<think>.*?</think>", ""))
    s = F.regexp_replace(s, r"(?i)^```(?:json)?\s*", "")
    s = F.regexp_replace(strip(s), r"\s*```$", "")
    body = F.regexp_extract(s, r"(?s)\{.*\}", 0)
    return F.when(body != "", body).otherwise(strip(s))


def without_trailing_commas(s: Column) -> Column:
    return F.regexp_replace(s, r",\s*([}\]])", "$1")


#: A string with its quotes; a backslash takes the next character along.
_QUOTED = r'(?s)"(?:[^"\\]++|\\.)*+"'


def close_brackets(s: Column) -> Column:
    """Truncated JSON with its open string and brackets closed: a pushdown automaton as a fold over the brackets outside of strings, with the closers owed as its stack.

    A closer that is not the one owed is passed over.
    """
    bare = F.regexp_replace(s, _QUOTED, "")
    brackets = F.regexp_extract_all(F.regexp_replace(bare, r'(?s)".*', ""), F.lit(r"[{}\[\]]"), F.lit(0))

    def step(owed: Column, c: Column) -> Column:
        return F.when(c == "{", F.concat(F.lit("}"), owed)).when(c == "[", F.concat(F.lit("]"), owed)).when(F.left(owed, F.lit(1)) == c, F.substring(owed, 2, 1 << 30)).otherwise(owed)

    return F.concat(s, F.when(F.contains(bare, F.lit('"')), F.lit('"')).otherwise(F.lit("")), F.aggregate(brackets, F.lit(""), step))


def _lenient(s: Column) -> Column:
    """A variant from near-JSON: single quotes, bare member names, comments, Python's constants, trailing commas."""
    plain = without_trailing_commas(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r":\s*None\b", ": null"), r":\s*True\b", ": true"), r":\s*False\b", ": false"))
    return F.from_json(plain, T.VariantType(), {"allowSingleQuotes": "true", "allowUnquotedFieldNames": "true", "allowComments": "true", "mode": "PERMISSIVE"})


def _object(s: Column, v: Column | None = None) -> Column:
    """``s`` (or its variant ``v``) as a variant when it is a JSON object with a member."""
    v = F.try_parse_json(s) if v is None else v
    return F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT<")) & (F.schema_of_variant(v) != "OBJECT<>"), v)


def repaired_json(raw: Column) -> Column:
    """The first reading that gives a non-empty object: as it is, without trailing commas, read leniently, closed, both; else null."""
    body = json_body(raw)
    read = F.coalesce(_object(body), _object(without_trailing_commas(body)), _object(body, _lenient(body)))
    closed = close_brackets(F.when(read.isNull(), body))  # the scan sees only what is still unread
    return F.coalesce(read, _object(closed), _object(without_trailing_commas(closed)))


def response_json(raw: Column) -> Column:
    """A model's reply as JSON: as it is, without trailing commas or read leniently as an object, else an empty object."""
    body = json_body(raw)
    return F.coalesce(F.try_parse_json(body), F.try_parse_json(without_trailing_commas(body)), _object(body, _lenient(body)), F.parse_json(F.lit("{}")))

"""Text functions: Column to Column, all of them built-in expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a question is stripped of, and the words and marks read as yes and no.
QUESTION_PHRASES_ZH = (
    "怎么办|什么样的|哪家|一下|那家|请问|啥样|咋样了|什么时候|何时|何地|何人|是否|是不是|多少|哪里|怎么|哪儿|怎么样|如何|哪些|是啥|啥是|啊|吗|呢|吧|咋|什么|有没有|呀|谁|哪位|哪个"
)
QUESTION_WORDS = "what|who|how|which|where|why"
QUESTION_STOPS = (
    "'s|'re|is|are|were|was|do|does|did|don't|doesn't|didn't|has|have|be|there|you|me|your|my|mine|just|please|may|i|should|would|wouldn't|"
    "will|won't|done|go|for|with|so|the|a|an|by|i'm|it's|he's|she's|they|they're|you're|as|by|on|in|at|up|out|down|of|to|or|and|if"
)
YES = r"(?i)(true|yes|是|\*|✓|✔|☑|✅|√)"
NO = r"(?i)(false|no|否|⍻|×)"
CJK = "一-龥"


WIDE = "".join(chr(0xFF01 + i) for i in range(94)) + "　"
NARROW = "".join(chr(0x21 + i) for i in range(94)) + " "


def to_half_width(c: Column) -> Column:
    """Full-width ASCII forms and the wide space as plain ASCII."""
    return F.translate(c, WIDE, NARROW)


BLANKS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def without_blanks(c: Column) -> Column:
    """Without the blanks of any width at both ends, as SQL trims; F.trim alone knows one only."""
    return F.btrim(c, F.lit(BLANKS))


def strip_question_words(c: Column) -> Column:
    """Chinese question words, and question and stop words before a space, out; the text as it was if nothing is left."""
    s = F.regexp_replace(c, f"是*({QUESTION_PHRASES_ZH})是*", "")
    s = F.regexp_replace(s, rf"(?i)(^| )({QUESTION_WORDS})('re|'s)? ", " ")
    s = F.regexp_replace(s, rf"(?i)(^| )({QUESTION_STOPS}) ", " ")
    return F.when(s == "", c).otherwise(s)


def space_latin_cjk(c: Column) -> Column:
    """A space between Latin and CJK runs."""
    c = F.regexp_replace(c, f"([A-Za-z]+[0-9]+|[A-Za-z])([{CJK}]+)", "$1 $2")
    return F.regexp_replace(c, f"([{CJK}]+)([A-Za-z])", "$1 $2")


def escape_query(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r'([:{}/\[\]\-*"()|+~^])', r"\\$1"))


WORD_BREAK = r"[^\p{L}\p{M}\p{N}]+"
#: Scripts without blanks between words, and the code points from which they (and full-width forms) start: plain texts skip what is for these.
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
UNSPACED_RUN = f"([{UNSPACED}]+)"
UNSPACED_PAIR = f"(?<=[{UNSPACED}])[{UNSPACED}](?![{UNSPACED}])|([{UNSPACED}])(?=([{UNSPACED}]))"
BEYOND_PLAIN = "[\u0e00-\u1fff\u2e80-\uffef\U00020000-\U0003ffff]"


def _words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), WORD_BREAK), lambda x: x != "")


def _by_script(c: Column, unspaced: Callable[[Column], Column]) -> Column:
    """Words of a text; where it has characters beyond the plain ones, in half width and after `unspaced`."""
    c = F.coalesce(c, F.lit(""))
    return F.when(c.rlike(BEYOND_PLAIN), _words(unspaced(to_half_width(c)))).otherwise(_words(c))


def tokens(c: Column) -> Column:
    """Lower-cased half-width words of letters, marks and digits of any script, in order; no stemming.

    A run of a script without blanks (Chinese, Japanese, Thai, Lao, Khmer, Burmese) is its overlapping pairs of characters; a single one is itself.
    """

    def pairs(c: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(c, UNSPACED_RUN, " $1 "), UNSPACED_PAIR, "$1$2 ")

    return _by_script(c, pairs)


def units(c: Column) -> Column:
    """Words, and each character of a script without blanks apart."""
    return _by_script(c, lambda t: F.regexp_replace(t, f"([{UNSPACED}])", " $1 "))


def fine_tokens(c: Column) -> Column:
    """Tokens, with those joined by / apart."""
    return F.flatten(F.transform(F.filter(F.split(F.lower(c), r"\s+"), lambda x: x != ""), lambda x: F.filter(F.split(x, "/"), lambda y: y != "")))


def n_tokens(c: Column) -> Column:
    """Words, and each character of a script without blanks."""
    return F.size(units(c)).cast("long")


def truncate_tokens(c: Column, n: int) -> Column:
    return F.array_join(F.slice(units(c), 1, n), " ")


def is_english(c: Column) -> Column:
    """Over 80 % of the characters are Latin letters, digits, blanks or plain punctuation."""
    return F.regexp_count(c, F.lit(r"[`a-zA-Z0-9\s.,':;/\"?<>!()\-]")) > 0.8 * F.length(c)


def is_chinese(c: Column) -> Column:
    return F.regexp_count(c, F.lit(f"[{CJK}]")) > 0.2 * F.length(c)


def is_cjk_query(c: Column) -> Column:
    """Three words or fewer, or at least 70 % of the words not alphabetic."""
    w = F.split(c, "[ \t]+")
    other = F.size(F.filter(w, lambda x: ~x.rlike("^[a-zA-Z]+$")))
    return (F.size(w) <= 3) | (other >= 0.7 * F.size(w))


def rm_space(c: Column) -> Column:
    """Spaces next to a character that is no ASCII letter, digit or mark, out."""
    c = F.regexp_replace(c, r"([^a-zA-Z0-9.,\)>]) +([^ ])", "$1$2")
    return F.regexp_replace(c, r"([^ ]) +([^a-zA-Z0-9.,\(<])", "$1$2")


def clean_str(c: Column) -> Column:
    """Basic HTML entities resolved, control characters and quotes out, trimmed."""
    for name, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(ch))
    return F.trim(F.regexp_replace(c, "[\"\\x00-\\x1f\\x7f-\\x9f]", ""))


def strip_table_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"</?(table|td|caption|tr|th)( [^<>]{0,12})?>", " ")


def content_id(*cols: Column) -> Column:
    return F.md5(F.concat_ws("\u0001", *cols))


def norm_bool(c: Column) -> Column:
    return F.when(F.trim(c).rlike(f"^{YES}$"), "yes").when(F.trim(c).rlike(f"^{NO}$"), "no")


DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "dd.MM.yyyy", "yyyy-MM-dd'T'HH:mm:ss")


def norm_dt(c: Column) -> Column:
    """yyyy-MM-dd HH:mm:ss of the first known form, else null."""
    at = F.coalesce(*(F.try_to_timestamp(F.trim(c), F.lit(f)) for f in DATE_FORMATS))
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss")


def safe_float(c: Column) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(float("-inf")))


def highlight(text: Column, keywords: Column) -> Column:
    """Sentences that hold a keyword, joined by '...', hits in <em>. keywords: alternatives of a regular expression."""
    pattern = F.concat(F.lit(r"(?i)\b("), keywords, F.lit(r")\b"))
    sentences = F.split(text, r"[.?!;\n]")
    marked = F.transform(sentences, lambda s: F.regexp_replace(F.trim(s), pattern, F.lit("<em>$1</em>")))
    return F.array_join(F.filter(marked, lambda s: s.contains("<em>")), "...")


def fix_citations(c: Column, n_chunks: int) -> Column:
    """(ID: 3), [ID: 3], 【ID: 3】 and ref3 as [ID:3], for numbers under n_chunks; others are left."""
    pattern = r"(?i)(?:[(\[【]\s*ID[: ]*\s*([0-9]{1,9})\s*[)\]】]|\bref\s*([0-9]{1,9}))"
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))

    def one(acc: Column, hit: Column) -> Column:
        n = F.regexp_extract(hit, "([0-9]+)", 1)
        return F.when(n.cast("long") < n_chunks, F.replace(acc, hit, F.concat(F.lit("[ID:"), n.cast("long").cast("string"), F.lit("]")))).otherwise(acc)

    return F.aggregate(F.array_distinct(found), c, one)


def citation_ids(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(r"\[ID:([0-9]+)\]"), F.lit(1)), lambda x: x.cast("long"))


def strip_think(c: Column) -> Column:
    return F.regexp_replace(c, "(?s)^.*</think>", "")


def strip_fence(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)^\s*```[a-z]*\s*|\s*```\s*$", "")


def between(c: Column, start: str, end: str) -> Column:
    import re

    return F.regexp_extract_all(c, F.lit(f"(?s){re.escape(start)}(.*?){re.escape(end)}"), F.lit(1))


def multi_split(c: Column, markers: list[str]) -> Column:
    """Split at any of the literal markers; trimmed, blanks out."""
    import re

    return F.filter(F.transform(F.split(c, "|".join(re.escape(m) for m in markers)), lambda y: F.trim(y)), lambda x: x != "")


def fill(template: str, **cols: Column) -> Column:
    """A template with {name} places."""
    return reduce(lambda acc, kv: F.replace(acc, F.lit("{%s}" % kv[0]), kv[1].cast("string")), cols.items(), F.lit(template))


def vote_label(c: Column, labels: list[str]) -> Column:
    """The label that occurs most often in the text; the earliest of equals; the first if none occurs."""
    import re

    marks = [F.struct(F.regexp_count(c, F.lit(f"(?i){re.escape(label)}")).alias("n"), F.lit(-i).alias("at"), F.lit(label).alias("label")) for i, label in enumerate(labels)]
    return F.array_max(F.array(*marks))["label"]


def grams(c: Column) -> Column:
    """The distinct 2-character pieces."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2))))


def sym_diff(a: Column, b: Column) -> Column:
    return F.concat(F.array_except(a, b), F.array_except(b, a))


def similar_name(a: Column, b: Column) -> Column:
    """Whether two names may mean one thing: by edits for Latin names, by common characters else; never if a digit tells them apart."""
    digits = F.exists(sym_diff(grams(a), grams(b)), lambda g: g.rlike("[0-9]"))
    latin = is_english(a) & is_english(b)
    edits = F.levenshtein(a, b) <= F.floor(F.least(F.length(a), F.length(b)) / 2)
    chars = lambda c: F.array_distinct(F.split(c, ""))
    most, both = F.greatest(F.size(chars(a)), F.size(chars(b))), F.size(F.array_intersect(chars(a), chars(b)))
    return ~digits & F.when(latin, edits).otherwise(F.when(most < 4, both > 1).otherwise(both >= 0.8 * most))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def domain(c: Column) -> Column:
    return F.regexp_extract(c, "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)


def clean_page(c: Column) -> Column:
    """Blanks as one space, tags out, only word characters and plain punctuation kept."""
    c = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "), "<[^>]+>", "")
    return F.trim(F.regexp_replace(c, r"[^\w\s.,!?;:\-()\[\]\"']", ""))


def page_title(title: Column, meta_title: Column, markdown: Column, url: Column) -> Column:
    """The given title, the metadata's, the first # heading, the last part of the URL, the URL."""
    blank = lambda c: F.when(c != "", c)
    return F.coalesce(blank(title), blank(meta_title), blank(F.trim(F.regexp_extract(markdown, r"(?m)^#\s+(.+)$", 1))), blank(F.element_at(F.split(url, "/"), -1)), url)


def page_description(markdown: Column, most: int = 200) -> Column:
    """The first paragraph without headings, cut with '...'."""
    body = F.regexp_replace(markdown, r"(?m)^#+\s+.*$", "")
    first = F.coalesce(F.get(F.filter(F.transform(F.split(body, "\n\n"), lambda y: F.trim(y)), lambda x: x != ""), 0), F.lit(""))
    return F.when(F.length(first) > most, F.concat(F.substring(first, 1, most), F.lit("..."))).otherwise(first)


# Words by which the language of a page is guessed, in this order.
LANGUAGE_WORDS = {
    "en": ("the", "and", "or", "but", "in", "on", "at"),
    "fr": ("le", "la", "les", "de", "du", "des"),
    "de": ("der", "die", "das", "und", "oder"),
    "es": ("el", "la", "los", "las", "de", "del"),
}


def page_language(c: Column) -> Column:
    """The first language of which the text contains a word, as a part of any word; en if none."""
    out = F.lit("en")
    for lang, found in reversed(LANGUAGE_WORDS.items()):
        out = F.when(F.lower(c).rlike("|".join(found)), lang).otherwise(out)
    return out


def max_category(arr: Column, order: list[str]) -> Column:
    """The element that comes last in an order of categories; unknown ones count for nothing."""
    ranks = F.create_map(*(x for i, v in enumerate(order) for x in (F.lit(v), F.lit(i))))
    return F.array_max(F.transform(arr, lambda v: F.struct(F.coalesce(ranks[v], F.lit(-1)).alias("rank"), v.alias("value"))))["value"]


def pack_positions(arr: Column) -> Column:
    """array<array<int>> as 8 hexadecimal digits each, joined by _."""
    return F.array_join(F.transform(F.flatten(arr), lambda x: F.lpad(F.lower(F.hex(x.cast("long"))), 8, "0")), "_")


def unpack_positions(c: Column, width: int = 5) -> Column:
    flat = F.transform(F.filter(F.split(c, "_"), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(flat) / width).cast("int") - 1), lambda i: F.slice(flat, i * width + 1, width))


def not_title(c: Column) -> Column:
    """Over 12 words, or 32 characters without a space, or sentence marks within."""
    return (F.size(F.split(c, " ")) > 12) | (~c.contains(" ") & (F.length(c) >= 32)) | c.rlike("[,;，。；！!]")


def distinct_keep(c: Column) -> Column:
    """Each element once, at its first place."""
    return F.array_distinct(c)


#: The beginnings of headings in five grammars, by level, and of lines that only look like headings.
GRAMMARS = (
    ("第[零一二三四五六七八九十百0-9]+(分?编|部分)", "第[零一二三四五六七八九十百0-9]+章", "第[零一二三四五六七八九十百0-9]+节", "第[零一二三四五六七八九十百0-9]+条", r"[\(（][零一二三四五六七八九十百]+[\)）]"),
    ("第[0-9]+章", "第[0-9]+节", r"[0-9]{0,2}[\. 、]", r"[0-9]{0,2}\.[0-9]{0,2}[^a-zA-Z/%~-]", r"[0-9]{0,2}\.[0-9]{0,2}\.[0-9]{0,2}", r"[0-9]{0,2}\.[0-9]{0,2}\.[0-9]{0,2}\.[0-9]{0,2}"),
    ("第[零一二三四五六七八九十百0-9]+章", "第[零一二三四五六七八九十百0-9]+节", "[零一二三四五六七八九十百]+[ 、]", r"[\(（][零一二三四五六七八九十百]+[\)）]", r"[\(（][0-9]{0,2}[\)）]"),
    ("PART (ONE|TWO|THREE|FOUR|FIVE|SIX|SEVEN|EIGHT|NINE|TEN)", "Chapter (I+V?|VI*|XI|IX|X)", "Section [0-9]+", "Article [0-9]+"),
    ("#[^#]", "##[^#]", "###", "####", "#####", "######"),
)
NOT_HEADING = r"0|[0-9]+ +[0-9~个只-]|[0-9]+\.{2,}"


def begins(c: Column, patterns) -> Column:
    return c.rlike("^(?:" + "|".join(patterns) + ")")


def heading_grammar(lines: Column) -> Column:
    """Which of GRAMMARS has the most headings among the lines (array<string>), the first of equals; -1 for none."""
    own = F.transform(lines, lambda x: F.regexp_replace(x, "^[\\s\u3000]+", ""))
    count = lambda g: F.size(F.filter(own, lambda x: begins(x, g) & ~begins(x, [NOT_HEADING])))
    hits = [count(g) for g in GRAMMARS]
    most = F.greatest(*hits)
    out = F.lit(-1)
    for i, h in reversed(list(enumerate(hits))):
        out = F.when((h > 0) & (h == most), i).otherwise(out)
    return F.when(lines.isNotNull(), out).otherwise(-1)


def heading_level(line: Column, grammar: Column) -> Column:
    """The place, from 1, of the first pattern of the line's grammar that it begins with; else null."""
    own = F.regexp_replace(line, "^[\\s\u3000]+", "")
    out = F.lit(None).cast("int")
    for g, patterns in enumerate(GRAMMARS):
        level = F.lit(None).cast("int")
        for i, pattern in reversed(list(enumerate(patterns, 1))):
            level = F.when(begins(own, [pattern]), i).otherwise(level)
        out = F.when(grammar == g, level).otherwise(out)
    return out


def without_contents(lines: Column, reach: int = 128) -> Column:
    """Lines without tables of contents.

    A line that names one goes, with what follows up to the place, within `reach` lines, where the first entry's
    beginning (its first two words, or three characters without a blank) comes again; else only that entry goes.
    """
    blank = lambda x: F.regexp_replace(x, "[\\s\u3000]+", "")
    is_mark = lambda x: F.lower(blank(x)).rlike("^(contents|tableofcontents|目录|目次|致谢|acknowledge)$")
    head = lambda x: F.regexp_extract(F.trim(x), r"^(\S+\s+\S+|.{1,3})", 1)
    at = lambda ok: F.filter(F.transform(lines, lambda x, i: F.when(ok(x, i), i)), lambda i: i.isNotNull())

    def span(m: Column) -> Column:
        first = F.get(at(lambda x, i: (i > m) & (blank(x) != "")), 0)
        again = F.get(at(lambda x, i: (i > first) & (i <= first + reach) & F.startswith(F.trim(x), head(F.get(lines, first)))), 0)
        return F.struct(m.alias("start"), F.coalesce(again, first + 1, m + 1).alias("stop"))

    spans = F.transform(at(lambda x, i: is_mark(x)), span)
    kept = F.filter(lines, lambda x, i: ~F.exists(spans, lambda s: (i >= s["start"]) & (i < s["stop"])))
    return F.when(F.exists(lines, is_mark), kept).otherwise(lines)

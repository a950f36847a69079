"""Text expressions: tokens, counts, sentences, similarity, highlighting, clean-up. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}"

#: Blanks and signs of ASCII, one by one: Java looks such a class up in a table, ranges are tried in turn.
INVISIBLE = "[" + "".join(f"\\x{c:02X}" for c in [*range(9, 14), *range(32, 48), *range(58, 65), *range(91, 97), *range(123, 127)]) + "]+"

LETTERS = "abcdefghijklmnopqrstuvwxyz"
ASCII_RUN = f"[0123456789{LETTERS}]++"

#: Words that search ignores.
STOP_WORDS = (
    "the", "and", "for", "with", "this", "that", "are", "was", "were", "been", "have", "has", "had", "not", "but",
    "from", "they", "will", "would", "could", "should", "can", "may", "might", "shall", "its", "his", "her", "our",
    "your", "their", "them",
)

HTML_ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def literal_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def runs(text: Column) -> Column:
    """Maximal runs of letters and digits, lower-cased; CJK runs stand apart. ASCII runs that ASCII ends are tried first."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"{ASCII_RUN}(?![^\x00-\x7F])|[{CJK}]+|[\p{{L}}\p{{N}}&&[^{CJK}]]+"), F.lit(0))


def cjk_parts(run: Column) -> Column:
    """A CJK run as its characters, then its adjacent pairs."""
    n = F.length(run)
    one = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(run, i, F.lit(1)))
    two = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(run, i, F.lit(2))))
    return F.concat(one, F.coalesce(two, F.array().cast("array<string>")))


def rag_tokens(text: Column) -> Column:
    """Search tokens with stop words kept. Runs of a text are only looked at one by one if it holds CJK."""
    cut = F.flatten(F.transform(runs(text), lambda r: F.when(r.rlike(f"^[{CJK}]"), cjk_parts(r)).otherwise(F.array(r))))
    return F.when(text.rlike(f"[{CJK}]"), cut).otherwise(runs(text))


def tokens(text: Column) -> Column:
    """Search tokens: lower-cased runs without stop words, CJK as characters and pairs."""
    return F.filter(rag_tokens(text), lambda t: ~t.isin(*STOP_WORDS))


def visible_counts(text: Column) -> Column:
    """``struct<c, l, b>``: numbers of CJK characters and of other visible ones, and whether any is no blank.

    They add up over joined texts. Blanks and signs of ASCII go first, by a class of single characters; the wider classes
    see only what isn't ASCII.
    """

    def of(text: Column) -> Column:
        def kinds(rest: Column, shown: Column) -> Column:
            other = F.length(F.regexp_replace(rest, rf"[\p{{Z}}\x{{85}}{CJK}]+", ""))
            return F.struct(F.length(F.regexp_replace(rest, f"[^{CJK}]+", "")).alias("c"), (F.length(shown) - F.length(rest) + other).alias("l"))

        def counted(shown: Column) -> Column:
            plain = F.struct(F.lit(0).alias("c"), F.length(shown).alias("l"))
            return F.when(is_ascii(shown), plain).otherwise(bound(F.regexp_replace(shown, r"[\x00-\x7F]+", ""), lambda rest: kinds(rest, shown)))

        whole = bound(F.regexp_replace(text, INVISIBLE, ""), counted)
        return bound(whole, lambda n: F.struct(n["c"].alias("c"), n["l"].alias("l"), (F.length(F.trim(text)) > 0).alias("b")))

    return bound(text, of)


def tokens_of_counts(n: Column) -> Column:
    return F.greatest(F.ceil(n["c"] / F.lit(1.5)) + F.ceil(n["l"] / F.lit(4.0)), n["b"].cast("long"))


def token_count(text: Column) -> Column:
    """Estimated model tokens: CJK characters over 1.5 plus other visible characters over 4, each rounded up."""
    return bound(visible_counts(text), tokens_of_counts)


def sentences(text: Column) -> Column:
    """Split after sentence marks and at line ends; blanks trimmed, empty pieces dropped."""
    parts = F.split(text, r"(?<=[.!?。！？；])\s+|\n")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda s: s != F.lit(""))


def shingles(words: Column, n: int) -> Column:
    """Distinct runs of ``n`` words joined by a blank; fewer words are one run."""

    def of(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.array_distinct(F.when(F.size(w) >= n, many).otherwise(F.array(F.array_join(w, " "))))

    return F.when(F.size(words) > 0, bound(words, of)).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two distinct arrays; two empty ones are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def char_bigrams(text: Column) -> Column:
    n = F.length(text)
    grams = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(text, i, F.lit(2)))
    return F.array_distinct(F.when(n > 1, grams).otherwise(F.array().cast("array<string>")))


def html_escape(text: Column) -> Column:
    for raw, safe in HTML_ENTITIES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def quoted(term: str) -> str:
    """A literal for a regular expression."""
    return "".join(c if c.isalnum() or c == " " else "\\" + c for c in term)


def highlight(text: Column, terms: list[str], tag: str = "em") -> Column:
    """Escape, then mark every term, longest first, in any case."""
    found = "|".join(quoted(t) for t in sorted({t for t in terms if t}, key=lambda t: (-len(t), t)))
    safe = html_escape(text)
    return F.regexp_replace(safe, f"(?i)({found})", f"<{tag}>$1</{tag}>") if found else safe


def highlight_sentences(text: Column, terms: list[str]) -> Column:
    """Only the sentences with a term, marked and joined by ``...``."""
    found = "|".join(quoted(t) for t in sorted({t for t in terms if t}, key=lambda t: (-len(t), t)))
    hit = F.filter(sentences(text), lambda s: s.rlike(f"(?i)({found})"))
    return F.array_join(F.transform(hit, lambda s: F.regexp_replace(s, f"(?i)({found})", "<em>$1</em>")), "...")


def entities(text: Column) -> Column:
    """Common character references as characters."""
    for safe, raw in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def html_to_text(html: Column) -> Column:
    """Visible text: scripts, styles and comments go, block ends become line ends, tags go, entities are read."""
    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>|</(p|div|li|tr|h[1-6]|title|ul|ol|table)>", "\n")
    out = entities(F.regexp_replace(out, r"<[^>]*>", ""))
    out = F.regexp_replace(out, r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(out, r" ?\n[ \n]*", "\n"), r"^\s+|\s+$", "")


def half_width(text: Column) -> Column:
    """Full-width forms and the ideographic blank as ASCII."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
    return F.translate(text, wide, "".join(chr(c) for c in range(0x21, 0x7F)) + " ")


def arabic_digits(text: Column) -> Column:
    return F.translate(text, "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")


def single_blanks(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def is_number(text: Column) -> Column:
    """Digits, once commas, points, percent signs and blanks are gone."""
    return F.regexp_replace(text, "[,.% ．]", "").rlike("^[0-9]+$")


def is_alphabetic(text: Column) -> Column:
    return text.rlike("^[A-Za-z]+$")


def is_mostly_cjk(text: Column) -> Column:
    """More than a fifth of the characters are Han."""
    return F.length(F.regexp_replace(text, r"[^\x{4E00}-\x{9FFF}]", "")) > F.length(text) * F.lit(0.2)


def is_english_query(text: Column) -> Column:
    """More than four fifths of the words are ASCII letters, digits and common signs."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != F.lit(""))
    plain = F.filter(words, lambda w: w.rlike(r"""^[A-Za-z0-9.,:;'/"?<>!()-]+$"""))
    return (F.size(words) > 0) & (F.size(plain) > F.size(words) * F.lit(0.8))


def is_english(text: Column) -> Column:
    """At least seven in ten characters are ASCII letters or blanks."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{LETTERS}{LETTERS.upper()} ]+", "")) >= F.length(text) * F.lit(0.7)


def is_table(text: Column) -> Column:
    """Table markup, or three lines with two bars each."""
    bars = F.filter(F.split(text, "\n"), lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) >= 2)
    return F.lower(text).rlike("<table|<tr") | (F.size(bars) >= 3)


def is_fact_dense(sentence: Column) -> Column:
    """A number, a percentage, or a capitalised word after the first."""
    return sentence.rlike(r"[0-9]") | sentence.rlike(r"\S\s+[A-Z][a-z]+")


def garbled_share(text: Column) -> Column:
    """Share of private-use, replacement and control characters."""
    odd = F.length(text) - F.length(F.regexp_replace(text, r"[\x{E000}-\x{F8FF}\x{FFFD}\x00-\x08\x0E-\x1F]", ""))
    return F.when(F.length(text) > 0, odd / F.length(text)).otherwise(F.lit(0.0))


def count_of(text: Column, term: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return (F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / F.lit(len(term))


def cited(text: Column) -> Column:
    """Numbers cited as ``[ID:n]`` or ``[n]``, each once."""
    found = F.regexp_extract_all(arabic_digits(text), F.lit(r"\[(?:ID:)?([0-9]+)\]"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: x.cast("int")))


def repaired_citations(text: Column, most: int) -> Column:
    """``(ID: n)``, ``[ID n]``, ``【ID: n】`` and ``ref n`` as ``[ID:n]`` for numbers below ``most``."""
    out = arabic_digits(text)
    low = below(most)
    for before, after in ((r"\(\s*ID\s*[: ]\s*", r"\s*\)"), (r"\[\s*ID\s*[: ]\s*", r"\s*\]"), (r"【\s*ID\s*[: ]\s*", r"\s*】"), (r"(?i:ref)\s*", r"(?![0-9])")):
        out = F.regexp_replace(out, f"{before}({low}){after}", "[ID:$1]")
    return out


def below(most: int) -> str:
    """A pattern of the numbers below ``most``, leading zeros allowed."""
    digits = str(max(most - 1, 0))
    parts = [f"[0-9]{{1,{len(digits) - 1}}}"] if len(digits) > 1 else []
    for i, c in enumerate(digits):
        top = int(c) - (i < len(digits) - 1)
        if top >= 0:
            parts.append(f"{digits[:i]}[0-{top}]" + "[0-9]" * (len(digits) - 1 - i))
    return "0*(?:" + "|".join(parts) + ")" if most > 0 else "(?!)"


#: Endings that stemming takes off, and what stays.
STEM_ENDINGS = (
    ("ations", ""), ("ation", ""), ("ated", ""), ("ates", ""), ("ate", ""), ("ings", ""), ("ing", ""), ("ies", "i"),
    ("ied", "i"), ("ed", ""), ("es", ""), ("s", ""),
)


def stem(word: Column) -> Column:
    """Without the first ending that leaves three letters; then a final y as i, a final e and a doubled consonant go."""
    out = word
    for ending, rest in reversed(STEM_ENDINGS):
        fits = F.endswith(word, F.lit(ending)) & (F.length(word) - len(ending) >= 3)
        out = F.when(fits, F.concat(F.left(word, F.length(word) - len(ending)), F.lit(rest))).otherwise(out)
    for pattern, rest in ((r"^(.{3,})y$", "$1i"), (r"^(.{3,})e$", "$1"), (r"^(.{2,}([^aeiou]))\2$", "$1")):
        out = F.regexp_replace(out, pattern, rest)
    return out


def truncated(text: Column, budget: int) -> Column:
    """The longest prefix of at most ``budget`` tokens: a range of lengths by doubling, then binary search in it.

    Only prefixes of up to twice the needed length are counted, however long the text is.
    """

    def within(n: Column) -> Column:
        return bound(F.left(text, n), lambda start: token_count(start) <= budget)

    def double(state: Column, _: Column) -> Column:
        def next_range(fits: Column) -> Column:
            high = F.least(state["high"].cast("long") * 2, F.length(text).cast("long")).cast("int")
            wider = F.struct(state["high"].alias("low"), high.alias("high"), (high > state["high"]).alias("open"))
            return F.when(fits, wider).otherwise(F.struct(state["low"].alias("low"), state["high"].alias("high"), F.lit(False).alias("open")))

        return F.when(state["open"], bound(within(state["high"]), next_range)).otherwise(state)

    def halve(state: Column, _: Column) -> Column:
        def fitted(mid: Column) -> Column:
            return F.when(within(mid), F.struct(mid.alias("low"), state["high"].alias("high"))).otherwise(F.struct(state["low"].alias("low"), (mid - 1).alias("high")))

        mid = F.floor((state["low"] + state["high"] + 1) / 2).cast("int")
        return F.when(state["low"] < state["high"], bound(mid, fitted)).otherwise(state)

    start = F.struct(F.lit(0).alias("low"), F.least(F.lit(4 * max(budget, 1)), F.length(text)).alias("high"), F.lit(True).alias("open"))
    ranged = F.aggregate(F.sequence(F.lit(1), F.lit(32)), start, double, lambda s: F.struct(s["low"].alias("low"), s["high"].alias("high")))
    cut = F.aggregate(F.sequence(F.lit(1), F.lit(32)), ranged, halve, lambda s: F.left(text, s["low"]))
    return F.when(F.length(text) <= budget, text).when(F.lit(budget > 0), cut).otherwise(F.when(token_count(text) <= budget, text).otherwise(""))


def plain_sentences(text: Column) -> Column:
    """Sentences with their marks; a point between digits, or after one, ends none."""
    parts = F.split(text, r"(?<=[。！？；!?;]|(?<![0-9])\.(?![0-9]))(?![。！？；!?;]|\.(?![0-9]))")
    return F.filter(parts, lambda x: F.regexp_replace(x, r"\s", "") != F.lit(""))


def starred(text: Column, words: list[str]) -> Column:
    """Each word between stars, longest first, in its own case."""
    found = "|".join(quoted(w) for w in sorted({w for w in words if w}, key=lambda w: (-len(w), w)))
    return F.regexp_replace(text, f"({found})", "*$1*") if found else text


def word_jaccard(a: Column, b: Column) -> Column:
    def words(x: Column) -> Column:
        return F.array_distinct(F.filter(F.split(F.lower(x), r"\s+"), lambda w: w != F.lit("")))

    return jaccard(words(a), words(b))


def char_overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of the characters."""

    def chars(x: Column) -> Column:
        return F.array_distinct(F.filter(F.split(x, ""), lambda c: c != F.lit("")))

    return jaccard(chars(a), chars(b))


def bigram_overlap(a: Column, b: Column) -> Column:
    """Common character pairs over the larger number of them."""
    x, y = char_bigrams(a), char_bigrams(b)
    return F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y), F.lit(1))


def snippet(text: Column, n: int) -> Column:
    cut = F.regexp_replace(F.left(F.trim(text), F.lit(n)), r"\s+$", "")
    return F.when(F.length(F.trim(text)) <= n, F.trim(text)).otherwise(F.concat(cut, F.lit("...")))


def excerpt(text: Column, term: str, before: int, size: int) -> Column:
    """``size`` characters around the first occurrence of a term, from the start where it has none; cut ends as ``...``."""
    at = F.instr(F.lower(text), term.lower())
    start = F.greatest(at - before, F.lit(1))
    cut = F.substring(text, start, F.lit(size))
    return F.concat(F.when(start > 1, "...").otherwise(""), cut, F.when(start + size - 1 < F.length(text), "...").otherwise(""))


def xml_escape(text: Column) -> Column:
    for raw, safe in HTML_ENTITIES[:4]:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def tight_blanks(text: Column) -> Column:
    """No blanks after opening and before closing signs."""
    out = F.regexp_replace(text, "(?i)([^a-z0-9.,)>]) +([^ ])", "$1$2")
    return F.regexp_replace(out, "(?i)([^ ]) +([^a-z0-9.,(<])", "$1$2")


def without_fence(text: Column) -> Column:
    """The inside of a Markdown fence."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"^\s*```markdown\s*\n?", ""), r"\n?\s*```\s*$", ""))


def speakable(text: Column, most: int = 500) -> Column:
    """Without control characters and emoji, blanks single, cut at ``most`` characters."""
    out = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]", "")
    return F.left(single_blanks(out), F.lit(most))


def without_hex(text: Column) -> Column:
    """Without runs of exactly 16 or 32 hexadecimal digits that stand alone."""
    for n in (16, 32):
        text = F.regexp_replace(text, f"(?<![0-9a-zA-Z])[0-9a-f]{{{n}}}(?![0-9a-zA-Z])", "")
    return text


def is_identifier(text: Column) -> Column:
    h = "[0-9a-fA-F]"
    return text.rlike(rf"^\s*([Cc]\d{{1,5}}|{h}{{16}}|{h}{{32}}|{h}{{8}}-{h}{{4}}-{h}{{4}}-{h}{{4}}-{h}{{12}})\s*$")


def spaced_scripts(text: Column) -> Column:
    """A blank between Latin words or numbered words and Han characters."""
    han = r"[\x{4E00}-\x{9FA5}]+"
    for left, right in (("[A-Za-z]+[0-9]+", han), ("[A-Za-z]", han), (han, "[A-Za-z]+[0-9]+"), (han, "[A-Za-z]")):
        text = F.regexp_replace(text, f"({left})({right})", "$1 $2")
    return text


def folded(text: Column, pairs: dict[str, str]) -> Column:
    """Characters replaced by their pairs, such as traditional by simplified ones."""
    return F.translate(text, "".join(pairs), "".join(pairs.values())) if pairs else text


#: Phrases before the matter of a question, and words that begin one.
FILLERS = (
    "please ", "can you ", "could you ", "would you ", "tell me ", "show me ", "give me ", "find me ", "i want to know ",
    "i would like to know ", "help me ", "explain to me ",
)
QUESTION_WORDS = ("what ", "how ", "why ", "when ", "where ", "who ", "which ", "is ", "are ", "do ", "does ", "did ")


def clean_query(text: Column) -> Column:
    """Lower case without the first of each filler phrase."""
    out = F.lower(text)
    for phrase in FILLERS:
        out = F.regexp_replace(out, f"(?s)^(.*?){phrase}", "$1")
    return F.trim(out)


def without_question_word(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "^(" + "|".join(QUESTION_WORDS) + ")", ""))


def expanded(text: Column, synonyms: dict[str, list[str]], most: int) -> Column:
    """Each word followed by at most two synonyms, at most ``most`` in all."""
    table = F.create_map(*[x for k, v in synonyms.items() for x in (F.lit(k), literal_array(v[:2]))])
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit(most).alias("left"))

    def step(state: Column, word: Column) -> Column:
        bare = F.lower(F.regexp_replace(word, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
        more = F.slice(F.coalesce(F.try_element_at(table, bare), F.array().cast("array<string>")), F.lit(1), state["left"])
        return F.struct(F.concat(state["out"], F.array(word), more).alias("out"), (state["left"] - F.size(more)).alias("left"))

    words = F.filter(F.split(text, r"\s+"), lambda w: w != F.lit(""))
    return F.aggregate(words, zero, step, lambda s: F.array_join(s["out"], " "))


def escaped_query(text: Column) -> Column:
    """Signs of a query language behind backslashes, single quotes gone."""
    return F.trim(F.regexp_replace(F.replace(text, F.lit("'"), F.lit("")), r"([:{}/\[\]\-*?\"()|+~^])", r"\\$1"))


def sub_queries(text: Column) -> Column:
    """Sentences of a long question, else its parts at the first of ``and``, ``or``, comma and semicolon that it has."""
    kept = F.filter(F.transform(F.split(text, r"(?<=[?？.。\n])"), lambda x: F.trim(x)), lambda x: F.length(x) > 3)
    parts = F.array(text)
    for word in (";", ", ", " or ", " and "):
        cut = F.filter(F.transform(F.split(text, quoted(word)), lambda x: F.trim(x)), lambda x: F.length(x) > 3)
        parts = F.when(F.contains(text, F.lit(word)), cut).otherwise(parts)
    short = (F.octet_length(text) < 30) & ~F.contains(text, F.lit(" and ")) & ~F.contains(text, F.lit(" or "))
    out = F.when(short, F.array(text)).when(F.size(kept) > 1, kept).otherwise(parts)
    return F.when(F.size(out) == 0, F.array(text)).otherwise(out)


def grep_terms(text: Column, most: int) -> Column:
    """Words of two characters and more that may hold points and dashes, each once."""
    found = F.transform(
        F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9][A-Za-z0-9_.\-]+"), F.lit(0)), lambda t: F.regexp_replace(t, r"^[._-]+|[._-]+$", "")
    )
    long = F.filter(found, lambda t: F.length(t) >= 2)
    first = F.filter(long, lambda t, i: ~F.array_contains(F.transform(F.slice(long, F.lit(1), i), lambda x: F.lower(x)), F.lower(t)))
    return F.slice(first, 1, most)


#: Endings of places and bodies, and function words.
PLACE_ENDINGS = (
    "市", "省", "县", "区", "镇", "乡", "村", "国", "州", "港", "岛", "河", "江", "湖", "山", "路", "街", "公司", "大学", "学院", "集团",
    "银行", "医院", "政府", "部", "局", "委", "所", "中心", "研究院", "联盟",
)
FUNCTION_WORDS = (
    "你", "我", "他", "她", "它", "这", "那", "哪", "谁", "什么", "怎么", "为什么", "如何", "怎样", "哪里", "哪儿", "何时", "哪些", "哪个",
    "多少", "是否", "是不是", "有没有", "吗", "呢", "吧", "啊", "呀", "咋", "的", "了", "着", "过", "就", "都", "也", "很", "太", "非常",
    "已经", "正在", "将", "会", "能", "可以", "应该",
)


def term_weight(term: Column) -> Column:
    """Weight of a term before it is scaled: rarity by its form, times its kind, times its part of speech by its form."""
    numeric, letters = term.rlike("^[0-9. -]{2,}$"), term.rlike("^[a-z. -]+$")

    def rarity(count: Column, of: float) -> Column:
        return F.log10(10 + (F.lit(of) - count + 0.5) / (count + 0.5))

    often = F.when(numeric, 3.0).when(letters, 300.0).otherwise(10.0)
    texts = F.when(numeric, 5.0).when(letters, 300.0).otherwise(3.0)
    kind = F.when(term.rlike("^[0-9,.]{2,}$"), 2.0).when(term.rlike("^[a-z]{1,2}$"), 0.01).otherwise(1.0)
    place = "(" + "|".join(PLACE_ENDINGS) + ")$"
    speech = F.when(term.rlike("^[0-9-]"), 2.0).when(term.rlike(place), 3.0).when(term.isin(*FUNCTION_WORDS), 0.3)
    speech = speech.when(term.rlike(f"^[{CJK}]{{2,}}$"), 2.0).otherwise(1.0)
    return (0.3 * rarity(often, 1e7) + 0.7 * rarity(texts, 1e9)) * kind * speech


def term_weights(terms: Column) -> Column:
    """``struct<term, weight>`` in order; weights sum to one."""

    def scaled(raw: Column) -> Column:
        total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(terms, raw, lambda t, w: F.struct(t.alias("term"), F.when(total > 0, w / F.nullif(total, F.lit(0.0))).otherwise(w).alias("weight")))

    return bound(F.transform(terms, term_weight), scaled)

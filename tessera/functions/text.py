"""Text functions: tokens, languages, synopses, Markdown and HTML, search in texts."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points that count as CJK (1.5 tokens); others beyond U+FFFF count 2, the rest a quarter.
CJK = r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{20000}-\x{2EBEF}]"
ASTRAL = r"[\x{10000}-\x{1FFFF}\x{2EBF0}-\x{10FFFF}]"
#: All of both are among these.
HEAVY = r"[\x{3040}-\x{10FFFF}]"

#: Frequent words by which Latin-script languages are told apart.
STOPWORDS = {
    "en": "a an and are as be document for from in is of on please project that the this to user with",
    "it": "che con da del della di documento e il la le non per preferenze progetto questo questa un una utente",
    "fr": "avec ce cette de des document du et la le les pour préférences projet que un une utilisateur",
    "es": "con de del documento el esta este la las los para preferencias proyecto que un una usuario y",
    "de": "benutzer das der die diese dieser dokument ein eine für ist mit nicht projekt und zu",
    "pt": "a as com da de do documento e este esta o os para preferências preferencias projeto que um uma usuário usuario",
}
#: Letters that speak for a language.
ACCENTS = {"it": "àèéìòù", "fr": "àâæçéèêëîïôœùûüÿ", "es": "áéíóúüñ¿¡", "de": "äöüß", "pt": "áâãàçéêíóôõú"}

#: Phrases of an answer that declines.
REFUSALS = ["not mentioned", "no information", "cannot be answered", "none", "unknown", "don't know"]


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once a row, though ``f`` uses it inside a lambda."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _number(text: Column, members: str) -> Column:
    """How many characters of a class a text has; runs are taken out at once, and no list of hits is made."""
    return F.char_length(text) - F.char_length(F.regexp_replace(text, f"[{members}]+", ""))


def _quarters(text: Column) -> Column:
    """Quarter tokens; of texts side by side they add up. Most texts have no character that counts more than one."""
    n = F.char_length(text)
    light = (F.octet_length(text) == n) | ~text.rlike(HEAVY)
    return F.when(light, n).otherwise(n + _number(text, CJK[1:-1]) * 5 + _number(text, ASTRAL[1:-1]) * 7).cast("long")


def estimate_tokens(text: Column) -> Column:
    return F.coalesce(F.ceil(_quarters(text) / 4), F.lit(0)).cast("long")


def _weight(chars: str) -> int:
    """Quarter tokens of a fixed text."""
    cjk, astral = (re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), p)) for p in (CJK, ASTRAL))
    return sum(6 if cjk.match(c) else 8 if astral.match(c) else 1 for c in chars)


def _fitting(chars: Column, room: int) -> Column:
    """How many of the first characters together weigh ``room`` quarter tokens at most."""

    def add(held: Column, c: Column) -> Column:
        used = held["used"] + F.when(c.rlike(CJK), 6).when(c.rlike(ASTRAL), 8).otherwise(1)
        return F.struct(used.alias("used"), (held["n"] + (used <= room).cast("int")).alias("n"))

    return F.aggregate(chars, F.struct(F.lit(0).alias("used"), F.lit(0).alias("n")), add)["n"]


def truncated(text: Column, budget: int, marker: str = "\n…\n") -> Column:
    """Texts over the budget keep three quarters of it from their head and a quarter from their end,
    by the weights of estimate_tokens; a marker that takes all of the budget is left out."""
    if _weight(marker) >= budget * 4:
        marker = ""
    room = max(0, budget * 4 - _weight(marker))
    head, tail = room * 3 // 4, room - room * 3 // 4
    # no character weighs less than a quarter token, so no more of them can fit
    first, last = F.split(F.substring(text, 1, head), ""), F.reverse(F.split(F.right(text, F.lit(tail)), ""))
    cut = F.concat(F.substring(text, F.lit(1), _fitting(first, head)), F.lit(marker), F.right(text, _fitting(last, tail)))
    return F.when(text.isNull() | (estimate_tokens(text) <= budget), text).otherwise(cut)


def detect_language(text: Column, fallback: str = "en") -> Column:
    """By script where that tells, else by frequent words and accents; weak or tied signals are English.

    Scripts and languages other than English, Chinese and ``fallback`` need a strong majority. Addresses
    don't count; a text without letters of any known script has the fallback."""
    addresses = F.regexp_replace(text, r"\b(?:\w+)://[^\s<>\])\"']+", " ")
    return once(F.when(F.contains(text, F.lit("://")), addresses).otherwise(F.coalesce(text, F.lit(""))), lambda t: _language(t, fallback))


def _language(t: Column, fallback: str) -> Column:
    ours = {"en", "zh-CN", fallback}
    scripts = {"zh-CN": r"\x{4E00}-\x{9FFF}", "ko": r"\x{AC00}-\x{D7AF}", "ru": r"\x{0400}-\x{04FF}", "ar": r"\x{0600}-\x{06FF}", "kana": r"\x{3040}-\x{30FF}\x{31F0}-\x{31FF}\x{FF66}-\x{FF9F}"}
    other = t.rlike(r"[\x{0250}-\x{10FFFF}]")  # most texts have no letter of another script
    counts = once(other, lambda o: F.struct(_number(t, r"A-Za-z\x{00C0}-\x{024F}").alias("latin"), *[F.when(o, _number(t, p)).otherwise(0).alias(k) for k, p in scripts.items()]))

    def judge(n: Column) -> Column:
        total = sum((n[k] for k in scripts), n["latin"])
        japanese = n["zh-CN"] + n["kana"]
        is_japanese = (n["kana"] >= 3) & (F.lit("ja" in ours) | ((n["kana"] >= 10) & (japanese >= 0.95 * total) & (n["kana"] >= 0.3 * japanese)))
        written = [k for k in scripts if k != "kana"]
        most = F.greatest(*[n[k] for k in written])
        script = F.lit(None).cast("string")
        for k in reversed(written):
            script = F.when(n[k] == most, k).otherwise(script)
        told = (most >= 2) & (most >= 0.20 * total) & (script.isin(*ours) | ((most >= 10) & (most >= 0.95 * total)))
        latin_language = once(F.lower(t), lambda low: _latin(low, ours))
        return F.when(total == 0, fallback).when(is_japanese, "ja").when(told, script).when(n["latin"] > 0, latin_language).otherwise(fallback)

    return once(counts, judge)


def _latin(lowered: Column, ours: set[str]) -> Column:
    """The text is split once; the languages' words and accents are counted among the few that any language has."""
    listed = {k: sorted(set(v.split())) for k, v in STOPWORDS.items()}
    words = F.split(lowered, r"[^a-z\x{00C0}-\x{024F}]+")
    known = lambda w: F.filter(w, lambda x: x.isin(*sorted(set().union(*listed.values()))))
    beyond = F.when(F.octet_length(lowered) == F.char_length(lowered), "").otherwise(F.regexp_replace(lowered, r"[\x00-\x7F]+", ""))
    found = once(words, lambda w: F.struct(F.size(F.array_remove(w, "")).alias("size"), known(w).alias("known"), beyond.alias("beyond")))

    def scored(f: Column) -> Column:
        def one(i: int, k: str) -> Column:
            stop = F.size(F.filter(f["known"], lambda x: x.isin(*listed[k])))
            accent = _number(f["beyond"], ACCENTS[k]) if k in ACCENTS else F.lit(0)
            pair = F.struct(stop.alias("stop"), accent.alias("accent"))
            return once(pair, lambda p: F.struct((p["stop"] + p["accent"]).alias("score"), F.lit(-i).alias("first"), F.lit(k).alias("lang"), p["stop"].alias("stop"), p["accent"].alias("accent")))

        return once(F.sort_array(F.array(*[one(i, k) for i, k in enumerate(listed)]), asc=False), lambda all_: judge(all_, f["size"]))

    def judge(all_: Column, size: Column) -> Column:
        best, english = F.get(all_, F.lit(0)), F.get(F.filter(all_, lambda x: x["lang"] == "en"), F.lit(0))["score"]
        strong = (size >= 20) & (best["score"] >= 6) & (best["score"] >= english + 4)
        ok = (size >= 6) & ((best["accent"] > 0) | (best["stop"] >= 4)) & (best["score"] >= 3) & (best["score"] >= english + 2) & (best["lang"].isin(*ours) | strong)
        return F.when((size < 3) | (best["lang"] == "en") | ~ok, "en").otherwise(best["lang"])

    return once(found, scored)


def looks_binary(text: Column) -> Column:
    head = F.substring(text, 1, 1000)
    return F.contains(head, F.lit("\0")) | (count(head, r"[\x01-\x08\x0B\x0C\x0E-\x1F]") > 0.05 * F.char_length(head))


def one_line(text: Column, most: int | None = None) -> Column:
    """White space collapsed; what is longer than ``most`` ends with an ellipsis."""
    line = F.btrim(F.regexp_replace(text, r"\s+", " "))
    return line if most is None else F.when(F.char_length(line) > most, F.concat(F.substring(line, 1, most - 3), F.lit("..."))).otherwise(line)


def digest(text: Column) -> Column:
    """SHA-256 of the text with plain line ends, without white space around it."""
    return F.sha2(F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"^\s+|\s+$", ""), 256)


def content_id(text: Column, name: Column | None = None) -> Column:
    h = F.sha2(text, 256)
    return F.concat(F.lit("tr_"), F.substring(h, 1, 24)) if name is None else F.concat(F.lit("tr_"), name, F.lit("_"), F.substring(h, 1, 16))


def body_key(text: Column) -> Column:
    return F.sha2(F.lower(one_line(text)), 256)


def normal_answer(text: Column) -> Column:
    t = F.regexp_replace(F.lower(F.replace(text, F.lit(","), F.lit(""))), r"[!-/:-@\[-`{-~]", "")
    return F.array_join(F.filter(F.split(t, r"\s+"), lambda w: ~w.isin("", "a", "an", "the", "and")), " ")


def refuses(text: Column) -> Column:
    low = F.lower(text)
    out = F.lit(False)
    for p in REFUSALS:
        out = out | F.contains(low, F.lit(p))
    return F.coalesce(out, F.lit(False))


def utf8_cut(text: Column, most: int) -> Column:
    """The longest prefix of at most ``most`` bytes that doesn't end inside a character."""
    raw = F.encode(text, "UTF-8")
    cut = F.substring(raw, 1, most)
    tries = [F.decode(F.substring(raw, 1, most - i), "UTF-8") for i in range(4)]
    whole = [~F.hex(F.substring(raw, most - i + 1, 1)).rlike("^[89AB]") for i in range(4)]  # no continuation byte follows
    out = tries[3]
    for t, w in reversed(list(zip(tries, whole, strict=True))):
        out = F.when(w, t).otherwise(out)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.when(F.length(cut) == 0, "").otherwise(out))


def media_strategy(n_images: Column, ratio: Column) -> Column:
    return F.when((ratio > 0.3) | (n_images >= 5), "full_page").when(n_images > 0, "extract").otherwise("text_only")


#: Elements that aren't part of a page's text.
ASIDE = ["script", "style", "head", "title", "nav", "header", "footer", "noscript", "svg", "form"]


def _without(html: Column, names: list[str]) -> Column:
    for n in names:
        html = F.regexp_replace(html, rf"(?is)<{n}\b[^>]*>.*?</{n}\s*>", " ")
    return F.regexp_replace(html, r"(?s)<!--.*?-->", " ")


def _plain(t: Column) -> Column:
    """No tags, entities as characters, white space collapsed, blank lines single."""
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t\r]+", " "), r" ?\n ?", "\n")
    return F.btrim(F.regexp_replace(t, r"\n{3,}", "\n\n"), F.lit(" \n"))


def html_text(html: Column) -> Column:
    """Main text of a page: no scripts, styles, navigation or tags, blank lines collapsed."""
    return _plain(F.regexp_replace(_without(html, ASIDE), r"(?i)<(br|/p|/div|/li|/tr|/h[1-6])\b[^>]*>", "\n"))


def _table_rules(html: Column) -> Column:
    """Cells between bars; the line under a table's first row has as many cells as that."""
    row = lambda t: F.regexp_extract(t, r"(?is)<tr\b[^>]*>(.*?)</tr\s*>", 1)
    rule = lambda t: F.concat(F.lit("\n| "), F.repeat(F.lit("--- | "), count(row(t), r"(?i)</t[hd]\s*>")))
    head = lambda t: F.instr(F.lower(t), "</tr")
    ruled = lambda t: F.concat(F.substring(t, F.lit(1), head(t) - 1), rule(t), F.substring(t, head(t), F.length(t)))
    parts = F.transform(F.split(html, r"(?i)(?=<table\b)"), lambda t: F.when(F.lower(t).startswith("<table") & (head(t) > 0), ruled(t)).otherwise(t))
    t = F.array_join(parts, "")
    t = F.regexp_replace(t, r"(?is)\s*</t[hd]\s*>[ \t]*", " | ")
    return F.regexp_replace(F.regexp_replace(t, r"(?is)\s*<tr\b[^>]*>\s*", "\n| "), r"(?i)</table\s*>", "\n\n")


def html_markdown(html: Column) -> Column:
    """A page as Markdown: headings, emphasis, links, images (none inline), lists and tables of its main
    part; the title as heading where the text hasn't got it; of a page without text its noscript notice."""
    t = _table_rules(_without(html, ASIDE))
    t = F.regexp_replace(t, r"(?i)<img\b[^>]*?src\s*=\s*['\"]data:image/[^>]*>", "")
    t = F.regexp_replace(t, r"(?is)<img\b[^>]*?src\s*=\s*['\"]([^'\"]*)['\"][^>]*>", "![]($1)")
    t = F.regexp_replace(t, r"(?is)<a\b[^>]*?href\s*=\s*['\"]([^'\"]*)['\"][^>]*>\s*(.*?)\s*</a\s*>", "[$2]($1)")
    for i in range(1, 7):
        t = F.regexp_replace(t, rf"(?is)<h{i}\b[^>]*>\s*(.*?)\s*</h{i}\s*>", f"\n\n{'#' * i} $1\n\n")
    for names, mark in ((("b", "strong"), "**"), (("i", "em"), "*"), (("code",), "`")):
        for n in names:
            t = F.regexp_replace(t, rf"(?is)<{n}(?:\s[^>]*)?>\s*(.*?)\s*</{n}\s*>", f"{mark}$1{mark}")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)<li\b[^>]*>\s*", "\n- "), r"(?i)<br\b[^>]*>", "\n")
    t = _plain(F.regexp_replace(t, r"(?i)</(p|div|ul|ol|section|article|blockquote|pre)\s*>", "\n\n"))
    t = F.regexp_replace(F.regexp_replace(t, r"!\[[^\]]*\]\(data:image/[^)]+\)", ""), r"\[ ?([^\[\]]*?) ?\]\(", "[$1](")
    notice = F.array_join(F.filter(F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<noscript\b[^>]*>(.*?)</noscript\s*>"), 1), lambda x: one_line(_plain(x))), lambda x: x != ""), "\n\n")

    def titled(body: Column) -> Column:
        title = one_line(_plain(html_title(html)))
        head = F.concat(F.lit("# "), title)
        return F.when((title == "") | F.contains(body, title), body).when(body == "", head).otherwise(F.concat(head, F.lit("\n\n"), body))

    return once(F.when(t == "", notice).otherwise(t), titled)


def html_title(html: Column) -> Column:
    return F.btrim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\b[^>]*?href="([^"]*)"'), 1)


def frontmatter(text: Column) -> tuple[Column, Column]:
    """The header between ``---`` lines, and the body."""
    head = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---\n", 1)
    return head, F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n", "")


def markdown_table(rows: Column) -> Column:
    """A padded pipe table out of rows of cells; the first row is the head."""
    n = F.array_max(F.transform(rows, lambda r: F.size(r)))
    width = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.greatest(F.lit(3), F.array_max(F.transform(rows, lambda r: F.char_length(F.coalesce(F.get(r, i), F.lit("")))))))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(width, lambda w, i: F.rpad(F.coalesce(F.get(r, i), F.lit("")), w, F.lit(" "))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(width, lambda w: F.repeat(F.lit("-"), w)), " | "), F.lit(" |"))
    lines = F.transform(rows, line)
    return F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, 1 << 20)), "\n")


def is_csv(text: Column, sep: str = ",") -> Column:
    """Two rows and two columns at least, and the first ten rows equally wide."""
    lines = F.slice(F.filter(F.split(text, r"\r?\n"), lambda x: F.btrim(x) != ""), 1, 10)
    wide = F.array_distinct(F.transform(lines, lambda x: F.size(F.split(x, sep))))
    return (F.size(lines) >= 2) & (F.size(wide) == 1) & (F.get(wide, F.lit(0)) >= 2)


def kind_of(text: Column) -> Column:
    """json, xml, csv, tsv, yaml, code, text or unknown."""
    t = F.btrim(text, F.lit(" \n\r\t"))
    is_json = (t.startswith("{") | t.startswith("[")) & F.try_parse_json(t).isNotNull()
    code = count(t, r"(?m)^\s*(def |class |import |from |function |return |#include|public |package )") >= 2
    return (
        F.when(F.coalesce(t, F.lit("")) == "", "unknown").when(is_json, "json").when(t.rlike(r"(?s)^<[A-Za-z?!].*>$"), "xml")
        .when(is_csv(t, "\t"), "tsv").when(is_csv(t), "csv").when(t.rlike(r"^(---\n)?[\w-]+:\s.*(\n\s*[\w-]+:|\n\s*- )"), "yaml")
        .when(code, "code").otherwise("text")
    )


def synopsis(text: Column) -> Column:
    return F.format_string("%s, %d characters, %d lines: %s", kind_of(text), F.char_length(text), F.size(F.split(text, "\n")), one_line(text, 80))


def json_shape(text: Column) -> Column:
    return F.schema_of_variant(F.try_parse_json(text))


def valid_text(raw: Column) -> Column:
    """Bytes as text; what isn't UTF-8 becomes the replacement character."""
    return F.make_valid_utf8(raw.cast("string"))


def lines(df: DataFrame, text: str) -> DataFrame:
    """A row for each line: line_no from 1, and line."""
    return df.select("*", F.posexplode(F.split(F.col(text), "\n"))).withColumn("line_no", F.col("pos") + 1).withColumnRenamed("col", "line").drop("pos")


def grep(df: DataFrame, text: str, pattern: str, *, ignore_case: bool = False) -> DataFrame:
    """Lines that the pattern finds; texts without any don't get to be split."""
    p = ("(?i)" if ignore_case else "") + pattern
    return lines(df.where(F.col(text).rlike(p)), text).where(F.col("line").rlike(p))


def read_slice(text: Column, offset: int, limit: int = -1) -> Column:
    """Lines offset .. offset + limit, with their line ends."""
    parts = F.split(text, "(?<=\n)")
    return F.array_join(F.slice(parts, offset + 1, (1 << 30) if limit < 0 else limit), "")


def snippets(df: DataFrame, text: str, needle: str, *, around: int = 300, most: int = 20) -> DataFrame:
    """Occurrences that don't overlap, ``most`` a text: offset in characters, and the text around it."""
    parts = F.slice(F.split(F.col(text), "\\Q" + needle + "\\E"), 1, most + 1)
    sizes = F.transform(parts, lambda p: F.char_length(p))
    at = once(sizes, lambda s: F.transform(F.sequence(F.lit(1), F.size(s) - 1), lambda i: F.aggregate(F.slice(s, 1, i), F.lit(0), lambda a, x: a + x) + (i - 1) * len(needle)))
    found = df.where(F.contains(F.col(text), F.lit(needle))).select("*", F.posexplode(at).alias("nth", "offset"))
    lo = F.greatest(F.lit(0), F.col("offset") - around)
    return found.withColumn("snippet", F.substring(F.col(text), lo + 1, F.col("offset") + len(needle) + around - lo))


def chunk(text: Column, offset: int, limit: int) -> tuple[Column, Column]:
    """A piece by characters, and whether there is more."""
    return F.substring(text, offset + 1, limit), F.char_length(text) > offset + limit


def _cut(text: Column, most: int) -> Column:
    """(piece, quarters) of each line; a line over ``most`` tokens by characters (of at most two tokens each)."""
    sized = lambda p: F.struct(p.alias("piece"), _quarters(p).alias("quarters"))
    small = lambda x: F.transform(F.regexp_extract_all(x, F.lit(f"(?s).{{1,{max(1, most // 2)}}}"), F.lit(0)), sized)
    lines_ = F.transform(F.split(text, "(?<=\n)"), sized)
    return F.flatten(F.transform(lines_, lambda x: F.when(x["quarters"] <= 4 * most, F.array(x)).otherwise(small(x["piece"]))))


def _packed(parts: Column, most: int, until: int) -> Column:
    """Neighbours joined while what is gathered is under ``until`` tokens and the sum fits. The fold adds up
    quarters and notes which parts go together; each text is joined once."""

    def joined(parts: Column) -> Column:
        group = lambda a: F.struct(a["at"].alias("at"), a["n"].alias("n"), a["quarters"].alias("quarters"))
        state = lambda *v: F.struct(*[c.alias(k) for k, c in zip(("done", "at", "n", "quarters"), v, strict=True)])

        def fold(a: Column, p: Column) -> Column:
            fits = (a["quarters"] <= 4 * (until - 1)) & (a["quarters"] + p["quarters"] <= 4 * most)
            more = state(a["done"], a["at"], a["n"] + 1, a["quarters"] + p["quarters"])
            return F.when(fits, more).otherwise(state(F.array_append(a["done"], group(a)), a["at"] + a["n"], F.lit(1), p["quarters"]))

        none = F.from_json(F.lit("[]"), "array<struct<at: int, n: int, quarters: bigint>>")
        groups = F.aggregate(parts, state(none, F.lit(1), F.lit(0), F.lit(0).cast("long")), fold, lambda a: F.array_append(a["done"], group(a)))
        return F.transform(groups, lambda g: F.struct(F.array_join(F.slice(parts, g["at"], g["n"])["piece"], "").alias("piece"), g["quarters"].alias("quarters")))

    return once(parts, joined)


def split_chunks(df: DataFrame, text: str, budget: int = 1024) -> DataFrame:
    """Pieces of at most ``budget`` tokens that make up the whole text again: (chunk, n).

    Paragraphs are packed in order while they fit; one over the budget is cut by characters (of at most two
    tokens each). The fold runs inside a row."""
    got = _packed(_cut(F.col(text), budget), budget, budget + 1)["piece"]
    return df.select("*", F.posexplode(F.filter(got, lambda c: c != "")).alias("n", "chunk"))


def pieces(text: Column, *, most: int = 1024, least: int = 512) -> Column:
    """A list of pieces that make up the whole text again, none over ``most`` tokens: the text itself if it
    fits, else its sections by Markdown headings; sections under ``least`` are merged with the next ones
    while they fit, those over ``most`` are cut at line ends, and where a line is over it, by characters."""
    sections = F.transform(F.split(text, r"(?m)(?=^#{1,6} )"), lambda p: F.struct(p.alias("piece"), _quarters(p).alias("quarters")))
    fitted = F.flatten(F.transform(sections, lambda p: F.when(p["quarters"] <= 4 * most, F.array(p)).otherwise(_packed(_cut(p["piece"], most), most, most))))
    got = F.when(_quarters(text) <= 4 * most, F.array(text)).otherwise(_packed(fitted, most, least)["piece"])
    return F.filter(got, lambda c: c != "")


def smart_split(df: DataFrame, text: str, *, most: int = 1024, least: int = 512) -> DataFrame:
    """A row for each of the ``pieces`` of a text: (n, chunk)."""
    return df.select("*", F.posexplode(pieces(F.col(text), most=most, least=least)).alias("n", "chunk"))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), 0)


def word_counts(text: Column) -> Column:
    """A map from word to count: the words are sorted, and a run's length is the way to the next one's start."""

    def counted(w: Column) -> Column:
        starts = F.filter(F.transform(w, lambda x, i: F.when((i == 0) | (x != F.get(w, i - 1)), F.struct(x.alias("t"), i.alias("at")))), lambda s: s.isNotNull())
        return once(starts, lambda s: F.map_from_entries(F.transform(s, lambda x, j: F.struct(x["t"], (F.coalesce(F.get(s, j + 1)["at"], F.size(w)) - x["at"]).cast("double")))))

    return once(F.sort_array(words(text)), counted)


def bm25(docs: DataFrame, key: str, text: str, terms: list[str], *, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of the texts that have any of the terms. Lengths are sums, and only the terms' own counts
    are made, inside each row, so nothing is exploded or shuffled but the two totals."""
    terms = sorted(set(terms))
    low = F.lower(F.col(text))
    tf = {t: count(low, rf"(?<![a-z]){re.escape(t)}(?![a-z])") for t in terms}
    rows = docs.select(key, count(low, "[a-z]+").cast("double").alias("len"), *[c.alias(f"tf_{i}") for i, c in enumerate(tf.values())])
    total = rows.agg(F.count("*").alias("n"), F.avg("len").alias("avg"), *[F.count_if(F.col(f"tf_{i}") > 0).alias(f"df_{i}") for i in range(len(terms))]).first()
    score = F.lit(0.0)
    for i in range(len(terms)):
        d = total[f"df_{i}"]
        idf = math.log(1 + (total["n"] - d + 0.5) / (d + 0.5))
        f = F.col(f"tf_{i}").cast("double")
        score = score + F.lit(idf) * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("len") / F.lit(float(total["avg"] or 1.0))))
    hit = F.greatest(*[F.col(f"tf_{i}") for i in range(len(terms))], F.lit(0)) > 0
    return rows.where(hit).select(key, score.alias("score"))


def link_first(text: Column, word: str, target: str) -> Column:
    """The first whole occurrence of a word becomes a Markdown link."""
    p = r"(?s)^(.*?)\b(" + re.escape(word) + r")\b"
    return F.regexp_replace(text, p, f"$1[$2]({target})")

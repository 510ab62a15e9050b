r"""Sentences of texts in any script, with their positions, in SQL expressions (problem 8).

What only looks like the end of a sentence is masked by private-use characters, one for one, so that positions stay those
of the text: points in numbers, addresses and initials, after abbreviations and ordinals, ellipses, and terminators
inside quoted speech. Tags, quote marks at line starts and line ends become private-use characters as well, which say
whether a break is hard (paragraph, quote depth, list item, signature) or soft (running text). The masked text is then
cut behind its terminators by one pattern with a branch per family of scripts, pieces are trimmed, and a window over the
few small rows of a document turns lengths into positions. The text is restored by cutting it at these positions.

Signatures are read from a line of --, ____ or ~~ on, if at most four lines with letters or digits follow it to the end of
the text; longer endings are running text behind a rule. Closing marks are taken up however many there are.

Defined results: null, empty and blank texts give no rows; pieces without letter or digit are no sentences; private-use
characters of the text itself are read as unknown symbols. Repeated rows are numbered each on its own. Texts of any
length are treated whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Placeholders, all in the private use area.
HARD, MARK, BREAK, INLINE, WHOLE, POINT, GAP, CUT = "\ue000", "\ue001", "\ue003", "\ue004", "\ue006", "\ue010", "\ue011", "\ue012"
_PRIVATE = "[\ue000-\ue012]"

TERMINATORS = ".!?…。！？｡؟।॥"

# Abbreviations that never end a sentence, those that don't before a figure or a small letter, months after an ordinal.
NEVER = (
    "dr dra mr mrs ms prof sgt capt lt col gen rev hon st mt ft sr sra srta jr vs cf viz vgl bzw ca evtl ggf inkl approx aprox pág vt e.g i.e s.t n.b u.a "
    "z d v n u i.d.r hr frl dipl ing bl tlk kd nn проф акад им ул гр тов т.е т.к т.н د أ م डॉ श्री श्रीमती कि.मी मि.मी से.मी"
)
BEFORE_FIGURE = "no nos nr nrs p pp fig figs vol ch sec abb s lk art cap tab kap str стр рис табл гл ок п см № núm págs ks jt u"
BEFORE_SMALL = (
    "etc jne jms usw usf u.a z.b a.m p.m am pm in ft oz lb sq mon tue tues wed thu thur thurs fri sat sun jan feb mar apr jun jul aug sep sept oct nov dec "
    "jh jhd okt dez г гг т д руб коп тыс млн др стр см напр т.д т.п ea p.o inc ltd co corp dept est u.n u.s u.k "
)
MONTHS = (
    "Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember Jan Feb Mär Apr Jun Jul Aug Sep Sept Okt Nov Dez "
    "Jh Jhd Jahrhundert Jahrhunderts Jahrhunderte"
)

_SPACES, _BULLETS, _FIGURES = " \t\n\x0b\f\r", "-*•‣·", "0123456789"
_WORDLIKE = r"[\p{L}\p{N}\p{M}]"
_SPACE = rf"[\s\u00a0{MARK}{BREAK}]"
_QUOTES = r"\"”“»’"
_BRACKETS = rf"){chr(92)}]】）{INLINE}"
_LOWER = r"\p{Ll}(?!\p{Lu})"


def _any(names: str) -> str:
    """Alternation of abbreviations; inner points are masked by then."""
    return "|".join(sorted((n.replace(".", POINT) for n in names.split()), key=len, reverse=True))


def _masked_markup(t: Column) -> Column:
    """Tags as runs of placeholders of their length: hard for blocks and quotes, a break for br, inline for the rest."""
    parts = F.split(t, r"(?=<[/A-Za-z!])|(?<=>)|(?=\[/?(?i:quote|b|i|u|s|url|img|code|list)\b)|(?<=\])", -1)

    def one(s: Column) -> Column:
        run = lambda c: F.repeat(F.lit(c), F.length(s))
        return (
            F.when(~s.startswith("<") & ~s.startswith("["), s)
            .when(s.rlike(r"^(?s)<br\b[^<>]*>$"), run(BREAK))
            .when(s.rlike(r"^(?si)(?:</?(?:p|div|blockquote|ul|ol|li|h[1-6]|hr|table|tr|td|th|pre|section|article)\b[^<>]*>|\[/?(?:quote|list|code)\b[^\]]*\])$"), run(HARD))
            .when(s.rlike(r"^(?si)(?:</?[a-z!][^<>]*>|\[/?(?:b|i|u|s|url|img)\b[^\]]*\])$"), run(INLINE))
            .otherwise(s)
        )

    return F.array_join(F.transform(parts, one), "")


def _first(c: Column, passed: str) -> Column:
    """The first character after those that are passed over: what a line begins with is seen from it, mostly, without a pattern."""
    return F.left(F.ltrim(c, F.lit(_SPACES + passed)), F.lit(1))


def _list_mark(c: Column) -> Column:
    return _first(c, HARD + INLINE).isin(*_BULLETS, *_FIGURES) & c.rlike(rf"^[\s{HARD}{INLINE}]*(?:[-*•‣·][ \t]+|\d{{1,3}}\)[ \t]+)\S")


def _number_mark(c: Column) -> Column:
    return _first(c, HARD + INLINE).isin(*_FIGURES) & c.rlike(rf"^[\s{HARD}{INLINE}]*\d{{1,3}}\.[ \t]+(?!\p{{Ll}}|(?:{_any(MONTHS)})\b)\S")


def _lines(t: Column) -> Column:
    """array<struct<pre, depth, body, blank, mark, num, sig>> of the lines."""

    def line(s: Column) -> Column:
        pre = F.when(F.ltrim(s, F.lit(" \t")).startswith(">"), F.regexp_extract(s, r"^[ \t]*(?:>[ \t]*)+", 0)).otherwise("")
        body = F.substr(s, F.length(pre) + 1)
        return F.struct(
            F.length(pre).alias("pre"), (F.length(pre) - F.length(F.replace(pre, F.lit(">"), F.lit("")))).alias("depth"), body.alias("body"),
            (~body.rlike(r"[\p{L}\p{N}]")).alias("blank"), _list_mark(body).alias("mark"), _number_mark(body).alias("num"),
            F.trim(body).isin("--", "____", "~~").alias("sig"),
        )

    return F.transform(F.split(t, "\n", -1), line)


def _ended(body: Column) -> Column:
    """Whether a line ends a sentence, or a block."""
    stop = body.rlike(rf"[{TERMINATORS}{HARD}][{_QUOTES}'」』{_BRACKETS}{HARD}\s]*$")
    return stop & ~body.rlike(rf"(?<!{_WORDLIKE})(?i:{_any(BEFORE_FIGURE)})\.\s*$")


def _joined(lines: Column, signature: Column) -> Column:
    """The lines as one text: quote marks masked, each line end soft (left as it is), hard, or hard before a whole line."""

    def one(l: Column, i: Column) -> Column:
        before = F.get(lines, i - 1)
        number = l["num"] & (before["blank"] | before["num"] | (before["depth"] != l["depth"]) | _ended(before["body"]))
        hard = l["blank"] | before["blank"] | (before["depth"] != l["depth"]) | l["mark"] | number
        sep = F.when(i == 0, "").when(i > signature, WHOLE).when(hard, HARD).otherwise("\n")
        return F.concat(sep, F.repeat(F.lit(MARK), l["pre"]), l["body"])

    return F.array_join(F.transform(lines, one), "")


def _inside(p: Column) -> Column:
    """Quoted speech with all terminators masked but one at its very end."""
    return F.regexp_replace(p, rf"(?s)[{TERMINATORS}](?=.)", POINT)


def _quoted(b: Column) -> Column:
    """A block with the terminators inside pairs of quotation marks masked."""

    def pairs(t: Column, opening: str, closing: str) -> Column:
        parts = F.split(t, rf"(?=[{opening}])|(?<=[{closing}])", -1)
        return F.array_join(
            F.transform(
                parts,
                lambda s: F.when(s.rlike(rf"^(?s)[{opening}].*[{closing}]$"), F.concat(_inside(F.substr(s, F.lit(1), F.length(s) - 1)), F.right(s, F.lit(1)))).otherwise(s),
            ),
            "",
        )

    for opening, closing in (("„", "“"), ("“", "”"), ("«「『", "»」』")):
        b = _bound(b, lambda t: F.when(t.rlike(rf"[{opening}]"), pairs(t, opening, closing)).otherwise(t))  # noqa: B023
    return _bound(b, _straight)


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _straight(b: Column) -> Column:
    straight = F.split(b, '"', -1)
    masked = F.array_join(F.transform(straight, lambda s, i: F.when((i % 2 == 1) & (i < F.size(straight) - 1), _inside(s)).otherwise(s)), '"')
    return F.when(F.contains(b, F.lit('"')), masked).otherwise(b)


def _block(b: Column, quotes: bool) -> Column:
    """A block with what doesn't end a sentence masked; quotes: whether there may be quotation marks."""
    mark = _first(b, HARD + MARK + BREAK).isin(*_BULLETS, *_FIGURES)
    listed = mark & b.rlike(rf"^[\s{HARD}{MARK}{BREAK}]*(?:[-*•‣·][ \t]+|\d{{1,3}}[.){POINT}][ \t]+)\S")
    named = F.rtrim(b, F.lit(_SPACES)).endswith(":") & ~b.rlike(rf"[{TERMINATORS}]")
    quoted = (lambda t: F.when(b.rlike(_ANY_QUOTE), _quoted(t)).otherwise(t)) if quotes else (lambda t: t)
    # An item goes on over wrapped lines, but ends with a line that ends a sentence.
    item = F.length(F.regexp_extract(b, rf"(?s)^[\s{HARD}{MARK}{BREAK}]*\S+\s.*?(?:[{TERMINATORS}][{_QUOTES}'」』{_BRACKETS}]*|[\u0e00-\u0e7f])[ \t]*(?=\n(?![\s{MARK}]*(?:\p{{Ll}}|[\d๐-๙])))", 0))
    first = _bound(item, lambda n: F.when(n == 0, _whole(b)).otherwise(F.concat(_whole(F.substr(b, F.lit(1), n)), F.lit(HARD), quoted(F.substr(b, n + 2)))))
    return F.when(b.startswith(WHOLE) | named, _whole(b)).when(listed, first).otherwise(quoted(b))


def _whole(b: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(b, rf"[{TERMINATORS}]", POINT), r"[\s\u00a0]", GAP)


_LEFT = rf"(?<!{_WORDLIKE})"
# All masks of points begin with the point: a place without one is passed over at once. What follows is looked at before what precedes.
_POINTS = "[.…](?:" + "|".join(
    [
        r"(?<=…)|(?=\.)|(?<=\.\.)",  # ellipses
        rf"(?={_WORDLIKE})(?<={_WORDLIKE}\.)",  # numbers, times, versions, addresses, inner points of abbreviations
        r"(?<=[ऀ-ॿ฀-๿]\.)",  # scripts that use the point for abbreviations only
    ]
) + ")"
_ABBREVIATIONS = rf"\.(?={_SPACE})(?:" + "|".join(
    [
        rf"(?<={_LEFT}(?iu:{_any(NEVER)})\.)",
        rf"(?={_SPACE}+\d)(?<={_LEFT}(?iu:{_any(BEFORE_FIGURE)})\.)",
        rf"(?={_SPACE}+{_LOWER})(?:(?<={_LEFT}\p{{L}}{{1,2}}\.)|(?<=\d\.)(?<={_LEFT}\d+\.)|(?<={_LEFT}(?iu:{_any(BEFORE_SMALL)})\.))",
        rf"(?={_SPACE}+(?:{_any(MONTHS)})(?!\p{{L}}))(?<={_LEFT}\d{{1,2}}\.)",
        rf"(?={_SPACE}+[\p{{Lu}}\d])(?<={_LEFT}\p{{Lu}}\.)",  # initials
    ]
) + ")"

_ON = rf"{_SPACE}+{INLINE}*+"
# A cut comes behind what one of these takes up: a terminator of a family of scripts with all its closing marks, however many.
# Spaced scripts; what may go on before a small letter is masked. After closing quotes only before a capital or opening mark.
_SPACED = rf"[.!?؟][{_BRACKETS}']*+(?:(?={_ON}[^\s{MARK}{BREAK}{HARD}{WHOLE}{INLINE}])|[{_QUOTES}][{_QUOTES}{_BRACKETS}]*+(?={_ON}(?:[\p{{Lu}}\"“„«¿¡(]|\p{{Ll}}\p{{Lu}})))"
_OTHERS = "|".join(
    [
        rf"[।॥][{_QUOTES}{_BRACKETS}]*+(?={_SPACE})",
        rf"[。！？｡][{_BRACKETS}]*+(?![。！？｡!?…\"”»’」』{_BRACKETS}{POINT}])",
        rf"[฀-๏๚-๿][{_QUOTES}{_BRACKETS}]*+(?={_SPACE}+[^\s\d๐-๙{MARK}{BREAK}{HARD}{WHOLE}])",
    ]
)
# What is looked for in whole texts is written in ranges: a range is one comparison a character, a list of characters one each.
_ANY_QUOTE, _RARE = "[\"«»“-„「-』]", "[।-॥฀-๿。！-｡]"
_IGNORED = " \t\n\x0b\f\r\u00a0\u200b\ufeff" + HARD + MARK + BREAK + WHOLE + GAP


def masked(text: Column) -> dict[str, Column]:
    """The steps from text to masked text by column name, each built on the one before."""
    c = F.col
    plain = F.when(text.rlike(_PRIVATE), F.regexp_replace(text, _PRIVATE, "�")).otherwise(text)
    plain = F.replace(F.replace(plain, F.lit("\r\n"), F.lit(" \n")), F.lit("\r"), F.lit("\n"))
    for entity, mark in (("&quot;", '"'), ("&#39;", "'")):
        plain = F.replace(plain, F.lit(entity), F.lit(mark + INLINE * (len(entity) - 1)))
    flags = F.transform(c("_lines"), lambda l: l["sig"])
    last = F.size(flags) - F.array_position(F.reverse(flags), True).cast("int")
    after = F.size(F.filter(F.slice(c("_lines"), last + 2, F.size(flags)), lambda l: ~l["blank"]))
    signature = F.when(F.array_contains(flags, True), F.when(after <= 4, last).otherwise(F.lit(1 << 30))).otherwise(F.lit(1 << 30))
    steps = {
        "_plain": plain,
        "_markup": F.when(c("_plain").rlike(r"[<\[]"), _masked_markup(c("_plain"))).otherwise(c("_plain")),
        "_lines": _lines(c("_markup")),
        "_sig": signature,
        "_joined": _joined(c("_lines"), c("_sig")),
    }
    points = F.regexp_replace(F.regexp_replace(c("_joined"), _POINTS, POINT), _ABBREVIATIONS, POINT)
    blocks = F.split(F.regexp_replace(c("_points"), rf"[{HARD}{WHOLE}]", rf"{CUT}$0"), CUT, -1)
    each = lambda quotes: F.array_join(F.transform(blocks, lambda b: _block(b, quotes)), "")
    return steps | {"_points": points, "_masked": F.when(c("_points").rlike(_ANY_QUOTE), each(True)).otherwise(each(False))}


def sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, sent_no, start_pos, end_pos: one row per sentence; positions in code points from 0, end excluded."""
    d = df.select(F.col(key), F.col(text).alias("_text")).where(F.length("_text") > 0).withColumn("_row", F.monotonically_increasing_id())
    for name, step in masked(F.col("_text")).items():
        d = d.withColumn(name, step)
    # No place is behind terminators of two families, so these are cut one after the other, the rare ones where they are only.
    d = d.withColumn("_masked", F.regexp_replace("_masked", _SPACED, rf"$0{CUT}"))
    d = d.withColumn("_masked", F.when(F.col("_masked").rlike(_RARE), F.regexp_replace("_masked", _OTHERS, rf"$0{CUT}")).otherwise(F.col("_masked")))
    # A hard break begins a piece, whose blanks it is trimmed with.
    cut = F.regexp_replace("_masked", rf"[{HARD}{WHOLE}]", rf"{CUT}$0")
    d = d.select(key, "_row", F.posexplode(F.split(cut, CUT, -1)).alias("_i", "_piece")).where(F.length("_piece") > 0)
    shorter = F.length(F.ltrim("_piece", F.lit(_IGNORED)))
    kept = F.length(F.btrim("_piece", F.lit(_IGNORED)))
    d = d.select(key, "_row", "_i", F.length("_piece").alias("_n"), (F.length("_piece") - shorter).alias("_lead"), kept.alias("_kept"), F.col("_piece").rlike(r"[\p{L}\p{N}]").alias("_real"))
    by = Window.partitionBy("_row").orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = (F.sum("_n").over(by) - F.col("_n") + F.col("_lead")).cast("int")
    d = d.select(key, F.sum(F.col("_real").cast("int")).over(by).cast("int").alias("sent_no"), start.alias("start_pos"), "_kept", "_real").where("_real")
    return d.select(key, "sent_no", "start_pos", (F.col("start_pos") + F.col("_kept")).alias("end_pos"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, sent_no, start_pos, end_pos of every sentence."""
    return sentences(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id", "text")


def p8_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """The sentences with their text, as it stands in the document."""
    d = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang", "text")
    s = p8_found(spark, folder).join(d, "doc_id")
    return s.select("doc_id", "lang", "sent_no", F.substr("text", F.col("start_pos") + 1, F.col("end_pos") - F.col("start_pos")).alias("sentence"))

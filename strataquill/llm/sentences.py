"""Sentence boundaries across languages and scripts, in SQL expressions.

Every character that looks like an end mark but is none (in decimals, URLs, initials, abbreviations, list numbers and
inside quotation marks or brackets) is replaced one for one by a private-use placeholder; what is left is split by the
terminators of each script. As placeholders keep all positions, the sentences are cut from the text as stored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataquill.functions.text import LOOKALIKE_FROM, LOOKALIKE_TO

# Abbreviations that never end a sentence, and those that may where a capital follows.
NEVER_FINAL = (
    "Mr", "Mrs", "Ms", "Dr", "Prof", "St", "vs", "approx", "No", "Nos", "Sec", "Fig", "Figs", "Art", "art", "Eq", "Vol", "pp", "cf", "e.g", "i.e", "viz",
    "Jan", "Feb", "Mar", "Apr", "Jun", "Jul", "Aug", "Sep", "Sept", "Oct", "Nov", "Dec", "Nr", "ca", "Tsd", "Mio", "Mrd", "bzw", "vgl", "Abs", "z. B", "d. h", "u. a", "z.B", "d.h", "u.a", "zzgl", "inkl",
    "Réf", "réf", "env", "p. ex", "M", "Mme", "MM", "al", "chap", "डॉ", "श्री", "प्रो", "रु",
)
OPENERS, CLOSERS = "“‘«„「『（(\\[【《〈\"", "”’»」』）)\\]】》〉\"'"
PAIRS = ("“”", "‘’", "«»", "「」", "『』", "（）", "()", "[]", "【】", "《》", "〈〉")
ENDS = ".。．！？｡।॥!?…"
BLANKS = "              　\t\n\r"
MASKED, AFTER_END, AFTER_TOLD_END, CUT = "", "", "", ""
CJK = "\\u2e80-\\u9fff\\uf900-\\ufaff"
BLOCK = 256
THAI = "[\\u0e01-\\u0e4e]"
BLANK = "[\\s\\u00a0\\u2000-\\u200a\\u202f\\u3000]"


def _token_pattern() -> str:
    """Enclosed stretches (with the colon before them) as whole tokens, everything else as runs.

    Repeats of groups are possessive: they never need to give anything back, and are matched in a loop, so that a stretch
    of any length takes no stack.
    """
    esc = lambda c: "\\" + c if c in "()[]" else c
    one = []
    for o, c in PAIRS:
        inner = f"[^{esc(o)}{esc(c)}]*"
        one.append(f"{esc(o)}{inner}(?:{esc(o)}{inner}{esc(c)}{inner})*+{esc(c)}")
    one += ["„[^„“”]*[“”]", '"[^"\\n]*(?:\\n(?!\\s*\\n)[^"\\n]*)*+"']
    enclosed = "|".join(one)
    return f"[:：]{BLANK}?(?:{enclosed})|{enclosed}|[^“‘«「『（(\\[【《〈„\":：]+|[\\s\\S]"


def _mask_enclosed(text: Column) -> Column:
    tokens = F.regexp_extract_all(text, F.lit(_token_pattern()), F.lit(0))
    hidden = ENDS + BLANKS

    def mask(t: Column) -> Column:
        closed = F.translate(t, hidden, MASKED * len(hidden))
        ended = t.rlike(f"[{ENDS}]{BLANK}?[{CLOSERS}“]$")
        told = t.rlike("^[:：]")
        mark = F.when(told, F.lit(AFTER_TOLD_END)).otherwise(F.lit(AFTER_END))
        closed = F.when(ended, F.concat(F.substring(closed, F.lit(1), F.length(closed) - 1), mark)).otherwise(closed)
        return F.when((F.length(t) > 1) & t.rlike(f"^(?:[:：]{BLANK}?)?[{OPENERS}]"), closed).otherwise(t)

    return F.array_join(F.transform(tokens, mask), "")


def mask_non_terminators(text: Column) -> Column:
    """``text`` with every mark that ends no sentence replaced, one for one, by a placeholder.

    Each pattern starts at the mark itself and looks back from there, so other characters cost one comparison.
    """
    m = _mask_enclosed(F.translate(text, LOOKALIKE_FROM, LOOKALIKE_TO))
    inside = "[.．!?](?=[\\u00ad\\u200b-\\u200d\\u2060\\ufeff]*[A-Za-z0-9０-９/_-])"
    initial = "\\.(?<=(?<![\\p{L}\\p{M}.])\\p{L}\\.)(?=\\s?(?:\\p{Lu}|\\p{L}\\.))"
    spelled = {v for w in NEVER_FINAL for v in (w, w[0].upper() + w[1:])}
    words = "|".join(sorted((w.replace(".", f"[.{MASKED}]") for w in spelled), key=lambda w: (-len(w), w)))
    short = f"\\.(?<=(?<![\\p{{L}}\\p{{M}}])(?:{words})\\.)(?!{BLANK}*\\z)"
    m = F.regexp_replace(m, f"{inside}|{initial}|{short}", MASKED)
    return F.regexp_replace(m, f"\\.(?<=(?:^|\\n|[.!?।。]{BLANK})[0-9]{{1,4}}\\.)(?={BLANK})", MASKED)


def _end_pattern() -> str:
    """Ends of sentences in masked text; everything but an end mark or a blank fails on the first test."""
    close, stop = f"[{CLOSERS}{AFTER_END}{AFTER_TOLD_END}]*", "[。．！？｡।॥]"
    starts = f"(?:[{OPENERS}]*[\\p{{Lu}}{CJK}\\u3040-\\u30ff\\u0900-\\u097f\\u0e00-\\u0e7f]|[{OPENERS}]|[0-9]{{1,4}}{MASKED}{BLANK})"
    over = f"(?:{BLANK}*\\z|[^\\S\\n]*\\n[^\\S\\n]*\\n)"
    marks = ENDS.replace(".", "", 1)
    at_mark = (
        f"{AFTER_TOLD_END}(?![{CLOSERS}{ENDS},，、;；])",
        f"{AFTER_END}(?={over}|{BLANK}+{starts})",
        f"[{marks}]*{stop}[{marks}]*{close}",
        f"…{{2,}}{close}",
        f"…{close}(?={over}|{BLANK}+{starts})",
        f"[!?]+{close}(?={BLANK}|\\z|[{CJK}\\u3040-\\u30ff])",
        f"\\.{close}(?={over}|{BLANK}+{starts})",
        f"\\.(?<=(?:\\p{{L}}{{5}}|[0-9%)€])\\.){close}(?={BLANK}+[0-9])",
    )
    thai = f"(?<={THAI})(?=[^\\S\\n]+{THAI}|[\\u00a0\\u2007\\u202f]+{THAI})"
    line = "(?<=\\S)(?=[^\\S\\n]*\\n[^\\S\\n]*\\n)"
    return f"(?=[{ENDS}{AFTER_END}{AFTER_TOLD_END}])(?:{'|'.join(at_mark)})|(?={BLANK})(?:{thai}|{line})"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(parts: Column, n: Callable[[Column], Column]) -> Column:
    """The sum of ``n`` over the elements before each one, and over all of them as the last element."""
    return F.aggregate(parts, F.array(F.lit(0)), lambda done, x: F.array_append(done, F.element_at(done, -1) + n(x)))


def sentence_spans(text: Column, with_text: bool = False) -> Column:
    """array<struct<start_pos, end_pos>> of the sentences: characters before the first one, and up to the last one.

    ``with_text`` adds ``sentence``, cut from the stored text block by block, as a cut of the whole text counts its
    characters from the start each time. Null gives null; a text of blanks only gives an empty array; a text without any end mark is one sentence.
    """
    chunks = F.split(F.regexp_replace(mask_non_terminators(text), f"(?:{_end_pattern()})", "$0" + CUT), CUT)
    size = lambda c: F.struct(F.length(c).alias("n"), F.length(F.rtrim(c, F.lit(BLANKS))).alias("kept"), F.length(F.ltrim(c, F.lit(BLANKS))).alias("led"))

    sizes = F.transform(chunks, size)

    # Positions are running sums, taken within blocks and over blocks, so that no array is copied once per sentence.
    def spans_of(block: Column, before: Column) -> Column:
        def span(chunk: Column, i: Column, sums: Column, part: Column | None) -> Column:
            start, end = F.get(sums, i) + chunk["n"] - chunk["led"], F.get(sums, i) + chunk["kept"]
            shown = [] if part is None else [F.substring(part, start + 1, end - start).alias("sentence")]
            return F.struct((before + start).alias("start_pos"), (before + end).alias("end_pos"), *shown)

        def all_of(sums: Column, part: Column | None) -> Column:
            return F.filter(F.transform(block, lambda c, i: span(c, i, sums, part)), lambda x: x["end_pos"] > x["start_pos"])

        if not with_text:
            return _let(_running(block, lambda c: c["n"]), lambda sums: all_of(sums, None))
        part = lambda sums: F.substring(text, before + 1, F.element_at(sums, -1))
        return _let(_running(block, lambda c: c["n"]), lambda sums: _let(part(sums), lambda p: all_of(sums, p)))

    def blocks_of(parts: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / BLOCK).cast("int")), lambda i: F.slice(parts, i * BLOCK + 1, F.lit(BLOCK)))

    total = lambda block: F.aggregate(block, F.lit(0), lambda n, c: n + c["n"])
    return _let(_let(sizes, blocks_of), lambda blocks: _let(_running(blocks, total), lambda sums: F.flatten(F.transform(blocks, lambda block, i: spans_of(block, F.get(sums, i))))))


def split_sentences(df: DataFrame, keys: list[str], text_col: str, with_text: bool = True) -> DataFrame:
    """One row per sentence: the key columns, sentence_index, start_pos, end_pos and (``with_text``) the sentence as stored.

    No shuffle and no Python: a projection over the scan. Rows with null or blank text give no rows; repeated rows
    repeat. Only the named columns of ``df`` are read; a key named like an output column raises ValueError.
    """
    clash = {"sentence_index", "start_pos", "end_pos", "sentence"} & set(keys)
    if clash:
        raise ValueError(f"key columns named like output columns: {sorted(clash)}")
    rows = df.select(*keys, F.col(text_col).alias("__text")).where("__text is not null")
    spans = rows.select(*keys, F.posexplode(sentence_spans(F.col("__text"), with_text)).alias("sentence_index", "__span"))
    return spans.select(*keys, "sentence_index", "__span.*")

"""Template residue, filler, error pages and script notices told from real text.

Texts are cut into segments (lines and sentences). Three regularised logistic models over hashed character n-grams,
length and title features score each segment: does it hold an unfilled placeholder, is it residue (filler, an error
message, a script notice), is it page furniture (a title, a date, a link label). They are fitted on weak labels, from
response-status wording and known phrases, of all segments of all texts, and can be validated on companies or wordings
held out of the fit.
A text is residue if a segment holds a placeholder (confirmed by an exact look at the segment), or if it has a residue
segment and no segment of content.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataquill.llm.arrays import BASE, chunks, code_points, hash_threshold, mix
from strataquill.session import new_path

BUCKETS = 1 << 18
GRAMS = (2, 3, 4)
#: Characters a step of the fit reads at least; smaller tables are read whole in every step.
SLICE = 1_000_000
#: Characters a task of a step reads at least.
TASK = 400_000
#: Score above which a segment may count as residue or furniture; a text is dropped only if all its segments do, and only
#: if one of them is residue beyond doubt. A short sentence of unknown words lies between the two and is kept.
LENIENT, CERTAIN = -1.0, 0.0
#: Score above which a segment is looked at for a placeholder.
PLACE = -4.0
#: Characters of the sentence of a text that is scored first, about.
PROBE = 40

# The forms of unfilled placeholders.
PLACEHOLDERS = (
    r"\{\{[^{}\n]{0,40}\}\}", r"\$\{[^{}\n]{0,40}\}", r"<%[^%\n]{0,40}%>", r"<<[^<>\n]{1,30}>>", r"%\(\w{1,30}\)[sd]", r"(?<![A-Za-z0-9_{$%])\{\d{1,2}\}(?!\})", r"\[\[[^\[\]\n]{0,30}\]\]",
    r"@@\w{1,30}@@", r"__[A-Z][A-Z_]*__", r"_{3,}", r"[Xx]{4,}|[ｘＸ]{3,}", r"×{2,}", r"#(?:N/A|REF!|VALUE!|DIV/0!|NAME\?|NUM!)#?", r"#[一-鿿]{2,8}#?",
    r"【\s*】|\[\s*\]|［\s*］|〔\s*〕", r"[【\[（(［〔](?:TBD|TBC|待[^】\])）\d]{1,8}|此处[^】\])）\d]{0,8}|请?填写[^】\])）\d]{0,8}|插入[^】\])）\d]{1,8}|[^】\])）\d]{0,4}(?:全称|简称)|INSERT [A-Z ]{1,20}|YOUR [A-Z ]{1,20}|insert [a-z ]{1,20}|your [a-z ]{1,20})[】\]）)］〕]",
    r"某某+|〇{2,}|○{2,}|□{2,}", r"(?i:yyyy[-/年]?mm[-/月]?dd)", r"\bTBD\b",
)
_PLACE_RE = re.compile("|".join(f"(?:{p})" for p in PLACEHOLDERS))

# Wording of filler, error pages and script notices, in lower case, digits as 0.
RESIDUE_PHRASES = (
    "占位段落|示例文字|示例标题|测试测试|正文内容正文内容|这里填写|lorem ipsum|dummy text|placeholder copy|sample text goes|your heading here|your paragraph here|test test test",
    "系统繁忙|会话已超时|重新登录|无权限查看|登录后重试|访问过于频繁|网络连接超时|不存在或已被删除|读取失败|已损坏或已过期|暂时无法显示|时发生异常|联系管理员|稍后再试|页面无法加载|未能取得",
    "脚本支持|禁用脚本|启用浏览器|开启 cookie|未运行 js|与脚本。|enable javascript|javascript is disabled|turn on cookies|requires scripts|switched off\\.|activer javascript|aktivieren sie javascript|javascript を有効",
    "too many requests|temporarily unavailable|session has expired|sign in again|access denied|do not have permission|could not load the|error code: 0|you are looking for has|internal server error|bad gateway|not found\\. the requested|could not be located",
    "erreur 0|introuvable\\.|accès refusé|veuillez vous reconnecter|momentanément indisponible|fehler 0|seite wurde nicht gefunden|zugriff verweigert|melden sie sich erneut|nicht erreichbar\\.|見つかりませんでした|アクセスが集中|閲覧権限がありません|错误 0：|ไม่พบหน้า|पृष्ठ नहीं मिला",
)
_RESIDUE_RE = re.compile("|".join(RESIDUE_PHRASES))
# Everyday words of user interfaces and servers, whatever the message; a feature, not a label.
SYSTEM_WORDS = (
    "browser|cookie|javascript|script|login|log in|logged|sign in|session|server|gateway|request|timeout|timed out|page|error|refresh|reload|retry|try again|unavailable|permission|denied|forbidden|unauthorised|unauthorized|not found|expired|loading|redirect|url|http|account|password|click|support|maintenance|template|placeholder|dummy|sample text|lorem|ipsum",
    "浏览器|脚本|登录|登陆|会话|服务器|网关|请求|超时|页面|网页|错误|刷新|重试|稍后|权限|拒绝|失败|异常|过期|加载|跳转|链接|网络|访问|账号|密码|点击|管理员|客服|维护|繁忙|系统|示例|占位|模板|测试|启用|禁用",
    "navigateur|serveur|erreur|connecter|accès|activer|indisponible|introuvable|seite|anmelden|sitzung|zugriff|fehler|aktivieren|erreichbar|ページ|サーバ|エラー|ブラウザ|ログイン|アクセス|有効|セッション|หน้า|เซิร์ฟเวอร์|ข้อผิดพลาด|पृष्ठ|सर्वर|त्रुटि|लॉगिन",
)


@lru_cache(1)
def _system_words():
    """All system words as one automaton, which reads a text once however many words there are."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for word in "|".join(SYSTEM_WORDS).split("|"):
        automaton.add_word(word, len(word))
    automaton.make_automaton()
    return automaton


def _status_codes(raw: np.ndarray) -> np.ndarray:
    """Where three digits from 400 to 559 stand alone, as response codes do, and not as part of a number, share or date."""
    if len(raw) < 3:
        return np.zeros(0, np.int64)
    digit = (raw >= 48) & (raw <= 57)
    hit = np.flatnonzero(((raw[:-2] == 52) | (raw[:-2] == 53)) & (raw[1:-1] >= 48) & (raw[1:-1] <= 53) & digit[2:])
    edge = np.concatenate([raw, [10]])
    near = np.array([ord(c) for c in "0123456789.,"], np.uint32)
    return hit[~np.isin(edge[hit - 1], near) & ~np.isin(edge[hit + 3], np.append(near, [ord(c) for c in "%年月日"]))]


_FURNITURE_RE = re.compile(r"^\W*(?:[0年月日\s./-]+|0+ \w{3,9}\.? 0+|(?:错误编号|请求标识|联系客服|返回首页|刷新|request id|error reference|contact support|back to home|reload)(?:\s*[:：].*)?)\W*$")
_ENDED_RE = re.compile(r"[。！？.!?…;；，,:：]\s*[”\"’»」）)]*\s*$")


@lru_cache(1)
def _fold() -> np.ndarray:
    """Code point -> folded code point: lower case, every digit as 0, every blank but the line break as one."""
    table = np.arange(0x10000, dtype=np.uint32)
    for c in range(0x10000):
        char = chr(c)
        if 0xD800 <= c < 0xE000:
            continue
        if char.isdigit():
            table[c] = 48
        elif char.isspace() and char != "\n":
            table[c] = 32
        elif len(char.lower()) == 1:
            table[c] = ord(char.lower())
    return table


def fold(text: str) -> str:
    return re.sub("0+", "0", "".join("0" if c.isdigit() else c for c in text.lower()))


@dataclass
class Segments:
    """Segments of a batch of texts: bounds in the row of code points, the text of each, and dense features."""

    codes: np.ndarray
    bounds: np.ndarray
    text: np.ndarray
    dense: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Segments:
        raw, starts = code_points(texts)
        codes = _fold()[np.minimum(raw, 0xFFFF)]
        blank = (codes == 32) | (codes == 10)
        letter = (codes >= 0x61) & ~np.isin(codes, [0x2026, 0x3002, 0xFF01, 0xFF1F]) | (codes == 48)
        cut = np.isin(codes, [10, 0x3002, 0xFF01, 0xFF1F, 0x21, 0x3F, 0x964])
        dot = codes == 46
        if len(codes) > 4:
            dot[:-1] &= blank[1:]
            dot[3:] &= letter[2:-1] & letter[1:-2] & letter[:-3]
            dot[:3] = False
        cut |= dot
        ends = np.zeros(len(codes) + 1, bool)
        ends[1:] = cut
        ends[starts] = True
        edges = np.flatnonzero(ends)
        lo, hi = edges[:-1], edges[1:]
        full = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(~blank, out=full[1:])
        solid = full[hi] - full[lo]
        keep = solid > 0
        lo, hi, solid = lo[keep], hi[keep], solid[keep]
        owner = (np.searchsorted(starts, lo, side="right") - 1).astype(np.int64)
        first = np.ones(len(lo), bool)
        first[1:] = owner[1:] != owner[:-1]
        ended = cut[hi - 1] & (codes[hi - 1] != 10) if len(hi) else cut[:0]
        digits = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(codes == 48, out=digits[1:])
        shown = codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        found = np.fromiter((end - size + 1 for end, size in _system_words().iter(shown)), np.int64)
        found.sort()
        words, status = (np.searchsorted(at, hi) - np.searchsorted(at, lo) for at in (found, _status_codes(raw)))
        dense = np.stack([np.ones(len(lo)), np.log1p(solid), first, ended, (digits[hi] - digits[lo]) / np.maximum(1, solid), (solid < 40) & ~ended, np.minimum(words, 3), words * 8 / np.maximum(8, solid), status > 0], axis=1).astype(np.float32)
        return cls(codes, np.stack([lo, hi], axis=1), owner, dense)

    def take(self, index: np.ndarray) -> Segments:
        """Some of the segments."""
        return Segments(self.codes, self.bounds[index], self.text[index], self.dense[index])

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """(characters of all segments in a row, length of each)."""
        sizes = self.bounds[:, 1] - self.bounds[:, 0]
        if len(sizes) and self.bounds[0, 0] == 0 and self.bounds[-1, 1] == len(self.codes) == sizes.sum():
            return self.codes, sizes
        return self.codes[np.repeat(self.bounds[:, 0] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))], sizes

    def around(self, positions: np.ndarray) -> np.ndarray:
        """Whether one of some positions, each that after a character, is in each segment."""
        return np.searchsorted(positions, self.bounds[:, 1], side="right") > np.searchsorted(positions, self.bounds[:, 0], side="right")

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(how many n-grams each segment has, the buckets of all in a row), for each n."""
        codes, sizes = self.joined()
        ends = np.cumsum(sizes)
        symbols = _mixed()[codes]
        hashed, whole = symbols, np.ones(len(codes), bool)
        for n in range(2, max(GRAMS) + 1):
            hashed = hashed[:-1] * np.uint64(BASE)
            hashed += symbols[n - 1 :]
            # No n-gram starts in the last n - 1 places of a segment.
            whole[(ends - n + 1)[sizes >= n - 1]] = False
            if n in GRAMS:
                yield np.maximum(sizes - n + 1, 0), (hashed[np.flatnonzero(whole[: len(hashed)])] >> np.uint64(46)).view(np.int64)


@lru_cache(1)
def _mixed() -> np.ndarray:
    return mix(np.arange(0x10000))


def holds_placeholder(segment: str) -> bool:
    """An unfilled placeholder that is not itself quoted as an example."""
    for hit in _PLACE_RE.finditer(segment):
        before, after = segment[hit.start() - 1 : hit.start()], segment[hit.end() : hit.end() + 1]
        if not (before in ("“", '"', "「", "«", "„", "'", "‘", "`") and before and after in ("”", '"', "」", "»", "“", "'", "’", "`") and after):
            return True
    return False


def weak_labels(segment: str, line: str, lorem: bool) -> tuple[bool, bool, bool]:
    """(placeholder, residue, furniture) of a segment by pattern, by phrases of its line, and by place.

    A phrase marks all sentences of a line that is not long; nonsense Latin marks its whole text.
    """
    place = holds_placeholder(segment)
    residue = not place and (lorem or len(line) < 240 and bool(_RESIDUE_RE.search(fold(line))))
    shown = fold(segment).strip()
    furniture = not place and not residue and (bool(_FURNITURE_RE.match(shown) or _FURNITURE_RE.match(fold(line).strip())) or len(shown) < 40 and not _ENDED_RE.search(shown) and "%" not in shown and len(line) < 60)
    return place, residue, furniture


@lru_cache(1)
def _triggers():
    """What folded text holds if a phrase of residue can be in it, as one automaton."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for word in FAMILIES:
        plain, digit, _ = word.replace("\\.", ".").partition("0")
        automaton.add_word(plain + digit, 1)
    automaton.make_automaton()
    return automaton


@lru_cache(1)
def _openings() -> tuple[np.ndarray, np.ndarray]:
    """(whether a form of placeholder can open with a folded code point, pairs of code points one of which every form holds, but those with #)."""
    openers, closers = "【[（(［〔", "】]）)］〕"
    pairs = ["{{", "${", "<%", "<<", "%(", "{0", "[[", "@@", "__", "xx", "ｘｘ", "××", "某某", "〇〇", "○○", "□□", "yy", "tb"]
    pairs += [a + b for a in "【[［〔" for b in ("】", "]", "］", "〕", " ", "\n")]
    pairs += [a + b for a in openers for b in "t待此请填插iy"] + ["称" + b for b in closers]
    first = np.zeros(0x10000, bool)
    first[[ord(p[0]) for p in pairs]] = True
    return first, np.unique([ord(a) << 16 | ord(b) for a, b in pairs])


def _odd(codes: np.ndarray) -> np.ndarray:
    """Where characters are that fold otherwise one by one, and are left to the patterns."""
    return np.flatnonzero((codes == 0xFFFF) | (codes == 0x130))


def places(codes: np.ndarray) -> np.ndarray:
    """Positions after what can be in a placeholder, in folded code points."""
    first, pairs = _openings()
    at = np.flatnonzero(first[codes[:-1]])
    key = codes[at].astype(np.int64) << 16 | codes[at + 1]
    at = at[pairs[np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)] == key]
    return np.sort(np.concatenate([at + 2, np.flatnonzero(codes == 35) + 1, _odd(codes) + 1]))


def suspects(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether each text can hold a phrase of residue, of texts in a row, folded to ``codes``."""
    shown = codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    phrase = np.zeros(len(starts) - 1, bool)
    phrase[np.searchsorted(starts, np.array([end + 1 for end, _ in _triggers().iter(shown)], np.int64), side="left") - 1] = True
    phrase[np.searchsorted(starts, _odd(codes), side="right") - 1] = True
    return phrase


def _starts(texts: list[str]) -> np.ndarray:
    """Where each text starts in the row of all, and the length of that."""
    return np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])


def marks(texts: list[str], seg: Segments) -> tuple[np.ndarray, np.ndarray]:
    """(weak label of every segment: 0 content, 1 placeholder, 2 residue, 3 furniture; whether each text can hold a phrase of residue).

    The same labels as those of ``weak_labels``, whose patterns are tried only where they can match.
    """
    codes, starts = seg.codes, _starts(texts)
    label = np.zeros(len(seg.bounds), np.uint8)
    phrase = suspects(codes, starts)
    if not len(label):
        return label, phrase
    lo, hi = seg.bounds.T
    may_place = seg.around(places(codes))
    solid, breaks = np.flatnonzero((codes != 32) & (codes != 10)), np.flatnonzero(codes == 10)
    inner = solid[np.searchsorted(solid, lo)]
    at = np.searchsorted(breaks, inner)
    line_lo = np.maximum(starts[seg.text], np.concatenate([[-1], breaks])[at] + 1)
    line_hi = np.minimum(starts[seg.text + 1], np.append(breaks, len(codes))[at])
    # Every run of zeros as one, as ``fold`` has it; none runs on from one text into the next.
    single = np.ones(len(codes), bool)
    single[1:] = (codes[1:] != 48) | (codes[:-1] != 48)
    single[starts[:-1][starts[:-1] < len(codes)]] = True
    to = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(single, out=to[1:])
    shown = codes[single].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    lorem = {i: "lorem ipsum" in texts[i].lower() for i in np.flatnonzero(phrase).tolist()}
    last, framed = -1, False
    columns = (lo, hi, to[lo], to[hi], seg.text, line_lo, line_hi, to[line_lo], to[line_hi], may_place)
    for i, (a, b, shown_a, shown_b, owner, line_a, line_b, frame_a, frame_b, place) in enumerate(zip(*(c.tolist() for c in columns), strict=True)):
        start = int(starts[owner])
        if owner in lorem:
            found = weak_labels(texts[owner][a - start : b - start], texts[owner][line_a - start : line_b - start], lorem[owner])
            label[i] = found.index(True) + 1 if True in found else 0
            continue
        if line_a != last:
            last, framed = line_a, bool(_FURNITURE_RE.match(shown[frame_a:frame_b].strip()))
        if place and holds_placeholder(texts[owner][a - start : b - start]):
            label[i] = 1
        elif framed:
            label[i] = 3
        else:
            piece = shown[shown_a:shown_b].strip()
            if _FURNITURE_RE.match(piece) or len(piece) < 40 and line_b - line_a < 60 and "%" not in piece and not _ENDED_RE.search(piece):
                label[i] = 3
    return label, phrase


def labelled(texts: list[str]) -> list[tuple[str, tuple[bool, bool, bool]]]:
    """Every segment with its weak labels."""
    seg, joined = Segments.of(texts), "".join(texts)
    return [(joined[lo:hi], (k == 1, k == 2, k == 3)) for (lo, hi), k in zip(seg.bounds.tolist(), marks(texts, seg)[0].tolist(), strict=True)]


@dataclass
class Model:
    """Weights of the scores, a column each: hashed n-grams and dense features. Models side by side follow one another."""

    grams: np.ndarray
    dense: np.ndarray

    def scores(self, seg: Segments) -> np.ndarray:
        return self.grams_scored(seg, list(seg.grams()))[0] + seg.dense @ self.dense

    def grams_scored(self, seg: Segments, grams: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """(scores by n-grams alone, what an n-gram of each segment counts)."""
        out = np.zeros((len(seg.bounds), self.grams.shape[1]), np.float32)
        count = np.zeros(len(seg.bounds), np.float32)
        for number, bucket in grams:
            if len(bucket):
                some = np.flatnonzero(number)
                out[some] += np.add.reduceat(self.grams.take(bucket, axis=0), (np.cumsum(number) - number)[some], axis=0)
                count += number
        value = 1 / np.sqrt(np.maximum(count, 1))
        return out * value[:, None], value

    def decide(self, texts: list[str]) -> tuple[Segments, np.ndarray]:
        """The segments of texts, and whether each holds a placeholder, is residue, is furniture."""
        seg = Segments.of(texts)
        return seg, told_by(texts, seg, self.scores(seg))

    def judge(self, texts: list[str]) -> np.ndarray:
        """For each text: 1 if a segment holds a placeholder, 2 if residue and no content, else 0."""
        seg = Segments.of(texts)
        verdict = np.zeros(len(texts), np.int8)
        if not len(seg.text):
            return verdict
        # A text with a segment of content can only be told by a placeholder, so one sentence of each text is scored first.
        size = seg.bounds[:, 1] - seg.bounds[:, 0]
        order = np.lexsort((np.abs(size - PROBE), seg.dense[:, ENDED] == 0, seg.text))
        probe = seg.take(order[np.flatnonzero(np.diff(seg.text[order], prepend=-1))])
        plain = np.zeros(len(texts), bool)
        plain[probe.text] = (self.scores(probe)[:, 1:] <= LENIENT).all(axis=1)
        rest = seg.take(np.flatnonzero(~plain[seg.text]))
        verdict = verdicts(rest, told_by(texts, rest, self.scores(rest), place=False), len(texts))
        held = seg.take(np.flatnonzero(seg.around(places(seg.codes))))
        held = held.take(np.flatnonzero(look(texts, held, np.arange(len(held.text)))))
        verdict[held.text[self.scores(held)[:, 0] > PLACE]] = 1
        return verdict


def look(texts: list[str], seg: Segments, index: np.ndarray) -> np.ndarray:
    """Whether each of some segments holds a placeholder, looked at with one character of its text on either side."""
    starts = _starts(texts)
    out = np.zeros(len(index), bool)
    for k, i in enumerate(index.tolist()):
        owner = int(seg.text[i])
        lo, hi = (seg.bounds[i] - starts[owner]).tolist()
        out[k] = holds_placeholder(texts[owner][max(0, lo - 1) : hi + 1])
    return out


def told_by(texts: list[str], seg: Segments, score: np.ndarray, place: bool = True) -> np.ndarray:
    """Whether each segment holds a placeholder (if asked for), is residue, is furniture by its scores."""
    told = score > LENIENT
    if len(told):
        sure = np.bincount(seg.text, weights=score[:, 1] > CERTAIN, minlength=len(texts)) > 0
        told[:, 1] &= sure[seg.text]
        told[:, 0] = False
        if place:
            likely = np.flatnonzero(score[:, 0] > PLACE)
            told[likely, 0] = look(texts, seg, likely)
    return told


def verdicts(seg: Segments, told: np.ndarray, size: int) -> np.ndarray:
    """For each of ``size`` texts: 1 if a segment holds a placeholder, 2 if residue and no content, else 0."""
    verdict = np.zeros(size, np.int8)
    if len(told):
        content = np.bincount(seg.text, weights=~(told[:, 1] | told[:, 2]), minlength=size)
        some = np.bincount(seg.text, weights=told[:, 1], minlength=size)
        verdict[(some > 0) & (content == 0)] = 2
        verdict[seg.text[told[:, 0]]] = 1
    return verdict


#: The wordings of residue, each a family that can be held out of a fit.
FAMILIES = tuple(w for group in RESIDUE_PHRASES for w in group.split("|"))


def _folds(folds: int) -> list[tuple[re.Pattern, re.Pattern]]:
    """For each fold the wordings that belong to it, and the others."""
    return [tuple(re.compile("|".join(w for j, w in enumerate(FAMILIES) if (j % folds == f) == here)) for here in (True, False)) for f in range(folds)]


@dataclass
class Rows:
    """Segments of a batch of texts with what a fit needs of them: folded characters, dense features, labels, and the models they are held out of, as bits."""

    codes: np.ndarray
    sizes: np.ndarray
    dense: np.ndarray
    label: np.ndarray
    without: np.ndarray

    @classmethod
    def of(cls, texts: list[str], without: list[re.Pattern] | None = None) -> Rows:
        """The segments of texts; one is held out of the i-th model if the i-th pattern occurs in its text."""
        seg = Segments.of(texts)
        label, phrase = marks(texts, seg)
        out = np.zeros(len(texts), np.int32)
        for i in np.flatnonzero(phrase).tolist() if without else ():
            shown = fold(texts[i])
            out[i] = sum(1 << m for m, pattern in enumerate(without) if pattern.search(shown))
        sizes = (seg.bounds[:, 1] - seg.bounds[:, 0]).astype(np.int32)
        return cls(seg.joined()[0].astype(np.uint16), sizes, seg.dense, label, out[seg.text])

    def packed(self) -> list[bytes]:
        return [x.tobytes() for x in (self.codes, self.sizes, self.dense, self.label, self.without)]

    @classmethod
    def unpacked(cls, codes: bytes, sizes: bytes, dense: bytes, label: bytes, without: bytes) -> Rows:
        sizes = np.frombuffer(sizes, np.int32)
        return cls(np.frombuffer(codes, np.uint16), sizes, np.frombuffer(dense, np.float32).reshape(len(sizes), -1), np.frombuffer(label, np.uint8), np.frombuffer(without, np.int32))

    def marked(self, models: int) -> np.ndarray:
        """Number of segments of each label in each model."""
        return np.stack([np.bincount(self.label[self.without >> m & 1 == 0], minlength=4) for m in range(models)])

    def add_slopes(self, model: Model, pull: np.ndarray, kinds: tuple[int, ...], grams: np.ndarray, dense: np.ndarray) -> None:
        """Adds the slopes of the loss to ``grams`` and ``dense``; ``pull`` is what a segment without and with each label of ``kinds`` weighs.

        A segment counts twice, and one of content once more as a text of its own, so that a short sentence standing
        alone is known as content too.
        """
        ends = np.cumsum(self.sizes, dtype=np.int64)
        seg = Segments(self.codes, np.stack([ends - self.sizes, ends], axis=1), np.zeros(0, np.int64), self.dense)
        found = list(seg.grams())
        score, value = model.grams_scored(seg, found)
        score += self.dense @ model.dense
        models = score.shape[1] // len(kinds)
        truth = np.tile(self.label[:, None] == kinds, models)
        used = np.repeat(self.without[:, None] >> np.arange(models) & 1 == 0, len(kinds), axis=1)
        chance = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        slope = 2 * (chance(score) - truth) * np.where(truth, pull[1], pull[0]) * used
        later = 1 - self.dense[:, FIRST]
        alone = chance(score + later[:, None] * model.dense[FIRST]) * pull[0] * (used & (self.label == 0)[:, None])
        both = slope + alone
        dense += self.dense.T @ both
        dense[FIRST] += later @ alone
        both *= value[:, None]
        bucket = np.concatenate([b for _, b in found])
        for k, column in enumerate(both.T.astype(np.float64)):
            grams[:, k] += np.bincount(bucket, weights=np.concatenate([np.repeat(column, number) for number, _ in found]), minlength=BUCKETS)


#: Number of dense features, and the places of "first segment of its text" and "ends as a sentence does".
WIDTH, FIRST, ENDED = 9, 2, 3
#: Labels that are scored; the verdict on a text without placeholders needs the last two only.
KINDS = (1, 2, 3)
ROWS_SCHEMA = "codes binary, sizes binary, dense binary, label binary, without binary"


def descend(slopes: Callable[[int, Model, np.ndarray], tuple[np.ndarray, np.ndarray]], marked: np.ndarray, width: int, kinds: tuple[int, ...], rounds: int = 60, decay: float = 2e-5, rate: float = 0.4) -> Model:
    """Logistic models side by side by Adam with an L2 penalty; ``slopes`` gives the slopes of a step, ``marked`` the number of segments by model and label.

    Both answers of a label weigh the same in all, however rare one is.
    """
    positives = 2.0 * marked[:, kinds].reshape(-1)
    total = np.repeat(2.0 * marked.sum(axis=1) + marked[:, 0], len(kinds))
    pull = np.stack([0.5 / np.maximum(1, total - positives), 0.5 / np.maximum(1, positives)])
    model = Model(np.zeros((BUCKETS, len(positives)), np.float32), np.zeros((width, len(positives)), np.float32))
    mean, spread = ([np.zeros_like(x) for x in (model.grams, model.dense)] for _ in range(2))
    for step in range(1, rounds + 1 if marked.any() else 1):
        got = slopes(step, model, pull)
        for k, x in enumerate((model.grams, model.dense)):
            # In stretches, so that no second copy of large weights is needed.
            for at in range(0, len(x), 1 << 14):
                w, m, v = (y[at : at + (1 << 14)] for y in (x, mean[k], spread[k]))
                grad = got[k][at : at + (1 << 14)].astype(np.float32) + (decay * w if k == 0 else 0)
                m[:] = 0.9 * m + 0.1 * grad
                v[:] = 0.99 * v + 0.01 * grad**2
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def slices(size: int, rounds: int = 60) -> int:
    """Into how many slices texts of ``size`` characters are cut; ``rounds`` is a multiple of it, so all slices are read equally often."""
    return max(b for b in range(1, rounds + 1) if rounds % b == 0 and (b == 1 or b * SLICE <= size))


def summed(rows: Iterable[Rows], model: Model, pull: np.ndarray, kinds: tuple[int, ...], times: int) -> tuple[np.ndarray, np.ndarray]:
    """``times`` the slopes of all rows."""
    grams, dense = np.zeros(model.grams.shape, order="F"), np.zeros(model.dense.shape)
    for r in rows:
        r.add_slopes(model, pull, kinds, grams, dense)
    grams *= times
    return grams, dense * times


def fit_rows(rows: list[Rows], models: int, batches: int, kinds: tuple[int, ...]) -> Model:
    """Models fitted on rows in memory."""
    marked = sum((r.marked(models) for r in rows), np.zeros((models, 4), np.int64))
    return descend(lambda step, model, pull: summed(rows[step % batches :: batches], model, pull, kinds, batches), marked, WIDTH, kinds)


def fit(texts: list[str], without: list[re.Pattern] | None = None, kinds: tuple[int, ...] = KINDS) -> Model:
    """The models of texts in memory; as many side by side as there are patterns ``without``, each without the texts its pattern occurs in."""
    rows = [Rows.of(texts[lo:hi], without) for lo, hi in chunks(texts, 100_000)]
    return fit_rows(rows, len(without or [0]), slices(sum(map(len, texts))), kinds)


def fit_all(docs: DataFrame, key: str, text_col: str, where: str = "true", without: list[re.Pattern] | None = None, kinds: tuple[int, ...] = KINDS) -> Model:
    """The models of ``fit``, on all texts of a table.

    The segments of all texts are written once in slices by a hash of their texts. Every step adds up, where the data
    are, the slopes of one slice, and all slices are read equally often: large tables once, small ones as a whole in every step.
    The driver holds only the weights and their slopes.
    """
    spark = docs.sparkSession
    texts = docs.where(F.col(text_col).isNotNull()).where(where).select(F.col(text_col).alias("t"), F.xxhash64(F.lit(11), key, text_col).alias("h"))
    size = texts.agg(F.sum(F.length("t").cast("long"))).first()[0] or 0
    models, batches = len(without or [0]), slices(size)

    def prepare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            whole, number = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for s in np.unique(number).tolist():
                chosen = [whole[i] for i in np.flatnonzero(number == s).tolist()]
                for lo, hi in chunks(chosen, 200_000):
                    rows = Rows.of(chosen[lo:hi], without)
                    yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.binary()) for x in rows.packed()), pa.array([rows.marked(models).reshape(-1).tolist()], pa.list_(pa.int64())), pa.array([s], pa.int32())], names=names)

    schema = T.StructType.fromDDL(f"{ROWS_SCHEMA}, marked array<bigint>, slice int")
    names = schema.names
    rows = texts.select("t", F.pmod("h", F.lit(batches)).cast("int").alias("s")).mapInArrow(prepare, schema)
    if size <= SLICE:
        return fit_rows([Rows.unpacked(*r[:5]) for r in rows.drop("marked", "slice").collect()], models, 1, kinds)
    # A task of a step has no less to do than what its start takes, and there are no more of them than run at once.
    tasks = max(1, min(max(8, spark.sparkContext.defaultParallelism), size // batches // TASK))
    path = new_path(spark, "residue")
    rows.write.partitionBy("slice").option("compression", "zstd").option("parquet.block.size", 4 << 20).parquet(path)
    stored = spark.read.schema(schema).parquet(path)
    marked = np.zeros(4 * models, np.int64)
    for r in stored.coalesce(tasks).select(F.posexplode("marked")).groupBy("pos").agg(F.sum("col").alias("n")).collect():
        marked[r.pos] = r.n

    def slopes(step: int, model: Model, pull: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shared = spark.sparkContext.broadcast((model, pull))

        def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            read = (Rows.unpacked(*(c[i].as_py() for c in batch.columns)) for batch in parts for i in range(batch.num_rows))
            out = summed(read, *shared.value, kinds, batches)
            yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.float32).tobytes()], pa.binary()) for x in out], names=["g", "d"])

        piece = stored.where(F.col("slice") == step % batches).select(*names[:5]).coalesce(tasks)
        got = piece.mapInArrow(add, "g binary, d binary").toArrow()
        shared.destroy()
        total = [np.zeros(x.shape, np.float32) for x in (model.grams, model.dense)]
        for x, column in zip(total, got.columns, strict=True):
            for part in column:
                x += np.frombuffer(part.as_buffer(), np.float32).reshape(x.shape)
        return total[0], total[1]

    return descend(slopes, marked.reshape(models, 4), WIDTH, kinds)


def family_counts(models: Model, texts: list[str], folds: int) -> np.ndarray:
    """For each fold: texts of residue that hold no other wording than its own, how many of them its model finds, and how many texts without any wording or placeholder it flags.

    ``models`` are those of the folds side by side, with scores of residue and furniture.
    """
    seg = Segments.of(texts)
    label, phrase = marks(texts, seg)
    may_place = np.zeros(len(texts), bool)
    may_place[np.searchsorted(_starts(texts), places(seg.codes), side="left") - 1] = True
    shown = {i: fold(texts[i]) for i in np.flatnonzero(phrase).tolist()}
    wording = np.array([bool(_RESIDUE_RE.search(shown[i])) if i in shown else False for i in range(len(texts))], bool)
    clean = ~wording & np.array([not (p and _PLACE_RE.search(t)) for p, t in zip(may_place.tolist(), texts, strict=True)], bool)
    whole = wording & (verdicts(seg, label[:, None] == np.arange(1, 4), len(texts)) == 2)
    score = models.scores(seg)
    out = np.zeros((folds, 3), np.int64)
    for f, (inside, outside) in enumerate(_folds(folds)):
        unseen = np.array([bool(w and inside.search(shown[i]) and not outside.search(shown[i])) for i, w in enumerate(whole.tolist())], bool)
        own = np.column_stack([np.full(len(score), -np.inf, np.float32), score[:, 2 * f : 2 * f + 2]])
        flagged = verdicts(seg, told_by(texts, seg, own), len(texts)) == 2
        out[f] = unseen.sum(), (flagged & unseen).sum(), (flagged & clean).sum()
    return out


def held_out_families(texts: list[str], folds: int = 5) -> list[tuple[int, int, int, int, int]]:
    """(fold, families, texts of residue, found, flagged of those without any wording) with whole families of wordings held out.

    A model is fitted on the texts in which no wording of the fold occurs, and judges the texts that are residue by their
    weak labels and hold no other wording than those of the fold, besides texts without any wording or placeholder.
    """
    models = fit(texts, [inside for inside, _ in _folds(folds)], KINDS[1:])
    counts = sum((family_counts(models, texts[lo:hi], folds) for lo, hi in chunks(texts, 200_000)), np.zeros((folds, 3), np.int64))
    return [(f, len(FAMILIES[f::folds]), *row) for f, row in enumerate(counts.tolist())]


def training_texts(docs: DataFrame, key: str, text_col: str, pool: int, where: str = "true", content: int = 2000, longest: int = 20_000) -> list[str]:
    """A bounded sample to try things out on, which no query uses: about ``pool`` texts of at most ``longest`` characters and least hash of their key, suspicious ones first.

    Rows are picked by a threshold on the hash in the scan, so nothing but the sample is sent to the driver; of texts
    without suspicious wording the first ``content`` are kept.
    """
    share = min(1.0, 1.1 * pool / max(1, docs.count()))
    rows = docs.where(f"length({text_col}) <= {longest}").where(where).select(F.col(text_col).alias("t"), F.xxhash64(F.lit(11), key).alias("h"))
    sample = rows.where(F.col("h") <= hash_threshold(share))
    texts = [r.t for r in sorted(sample.collect(), key=lambda r: (r.h, r.t))[:pool]]
    odd = [bool(_PLACE_RE.search(t) or _RESIDUE_RE.search(fold(t))) for t in texts]
    return [t for t, o in zip(texts, odd, strict=True) if o] + [t for t, o in zip(texts, odd, strict=True) if not o][:content]


def find_residue(docs: DataFrame, key: str, text_col: str, model: Model | None = None) -> DataFrame:
    """(key, kind) of texts that are template residue: ``placeholder``, or ``filler`` for filler, errors and notices.

    The model is fitted on all texts (``fit_all``) and has a fixed size (3 MB); every text is then judged whole in one
    pass without a shuffle but for repeated rows. Null, empty and blank texts are never residue.
    """
    if model is None:
        model = fit_all(docs, key, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.where(F.col(text_col).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(text_col).alias("t"))
    schema = T.StructType([T.StructField(key, rows.schema["k"].dataType), T.StructField("kind", T.StringType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            verdict = np.concatenate([shared.value.judge(texts[lo:hi]) for lo, hi in chunks(texts, 200_000)] or [np.zeros(0, np.int8)])
            hit = np.flatnonzero(verdict)
            kinds = pa.array(["placeholder" if v == 1 else "filler" for v in verdict[hit]], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(hit, pa.int64())), kinds], names=schema.names)

    return rows.mapInArrow(judge, schema).distinct()


def validate_families(docs: DataFrame, key: str, text_col: str, folds: int = 5) -> DataFrame:
    """(fold, families, texts, found, recall, false_alarms) of models that have never seen the wordings of their fold, fitted on and counted over all texts."""
    models = fit_all(docs, key, text_col, without=[inside for inside, _ in _folds(folds)], kinds=KINDS[1:])
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((folds, 3), np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for lo, hi in chunks(texts, 200_000):
                sums += family_counts(shared.value, texts[lo:hi], folds)
        yield pa.RecordBatch.from_arrays([pa.array(range(folds), pa.int32()), *(pa.array(c) for c in sums.T)], names=["fold", "texts", "found", "wrong"])

    counts = docs.where(F.col(text_col).isNotNull()).select(text_col).mapInArrow(compare, "fold int, texts long, found long, wrong long")
    found = {r.fold: r for r in counts.groupBy("fold").agg(*(F.sum(c).alias(c) for c in ("texts", "found", "wrong"))).collect()}
    rows = []
    for f in range(folds):
        seen, hit, wrong = (found[f].texts, found[f].found, found[f].wrong) if f in found else (0, 0, 0)
        rows.append((f, len(FAMILIES[f::folds]), seen, hit, hit / seen if seen else None, wrong))
    return docs.sparkSession.createDataFrame(rows, "fold int, families int, texts long, found long, recall double, false_alarms long")


def validate(docs: DataFrame, key: str, text_col: str, host_col: str, held_out: int = 5) -> DataFrame:
    """Agreement with the weak labels on all texts of hosts left out of the fit: (label, segments, precision, recall).

    A host is held out if the hash of ``host_col`` is divisible by ``held_out``; the model is fitted on all texts
    of the others. Decisions are those of ``find_residue``. ``segments`` counts what the weak labels mark; in the row
    ``text`` these are whole texts that are residue by their labels.
    """
    inside = f"pmod(xxhash64(coalesce(cast({host_col} as string), '')), {held_out})"
    model = fit_all(docs, key, text_col, f"{inside} != 0")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((4, 3), np.int64)
        for batch in batches:
            whole = batch.column(0).to_pylist()
            for lo, hi in chunks(whole):
                texts = whole[lo:hi]
                seg, told = shared.value.decide(texts)
                truth = marks(texts, seg)[0][:, None] == np.arange(1, 4)
                pairs = [*zip(truth.T, told.T, strict=True), (verdicts(seg, truth, len(texts)) > 0, verdicts(seg, told, len(texts)) > 0)]
                sums += np.array([(t.sum(), d.sum(), (t & d).sum()) for t, d in pairs])
        yield pa.RecordBatch.from_arrays([pa.array(range(4), pa.int32()), *(pa.array(c) for c in sums.T)], names=["label", "marked", "told", "both"])

    held = docs.where(F.col(text_col).isNotNull()).where(f"{inside} = 0").select(text_col)
    counts = held.mapInArrow(compare, "label int, marked long, told long, both long").groupBy("label").agg(*(F.sum(c).alias(c) for c in ("marked", "told", "both")))
    found = {r.label: r for r in counts.collect()}
    rows = []
    for k, name in enumerate(("placeholder", "residue", "furniture", "text")):
        marked, told, both = (found[k].marked, found[k].told, found[k].both) if k in found else (0, 0, 0)
        rows.append((name, marked, both / max(1, told), both / max(1, marked)))
    return docs.sparkSession.createDataFrame(rows, "label string, segments long, precision double, recall double")

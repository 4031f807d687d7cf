"""Repair of text from scanned pages: furniture, broken words and misread characters.

A text is a sequence of places that can be edited: characters and words that may be
misread, figures with letters in them, hyphens at line ends.  An averaged perceptron with
one set of weights a class decides for every place between keeping, replacing a character,
deleting one (two were read for one), inserting one (one was read for two) and joining the
line with the next.  It looks at how often the place's surroundings and what they would
become occur in all texts, and is trained on clean pages into which misreadings are put.

Places that read alike are decided once: they are counted over all texts, the counts of
what they could become join them by key, and the decisions go back to the texts.  So no
count is held in one place, and nothing grows with the vocabulary but tables.

Running headers are told by where on their pages lines of one shape stand, page numbers by
the page of the hit.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.runtime import cut

# What a recogniser takes for what, misread form first.
MISREAD_HAN = {
    "兀": "元", "严": "产", "刊": "利", "日": "目", "此": "比", "人": "入", "颔": "额", "劣": "务", "朋": "期", "顶": "项", "隹": "售", "垷": "现", "曰": "日", "憎": "增", "涧": "润", "木": "本",
    "末": "未", "未": "末", "千": "干", "干": "千", "士": "土", "土": "士", "午": "年", "贞": "页", "吿": "告", "己": "已", "已": "己", "大": "太", "田": "由", "甲": "申", "兔": "免", "扳": "板", "侍": "待", "徽": "微", "夭": "天", "戍": "成", "拆": "折", "析": "折", "枚": "权", "问": "间", "间": "问", "佘": "余", "治": "冶", "皎": "较", "王": "主",
}
MISREAD_LATIN = [("c", "e"), ("0", "o"), ("5", "s"), ("cl", "d"), ("1", "l"), ("rn", "m"), ("ii", "u"), ("b", "h"), ("n", "ri"), ("m", "rn"), ("\u00ed", "i"), ("vv", "w"), ("6", "b"), ("8", "b"), ("9", "g"), ("1", "i"), ("l", "i"), ("tl", "d"), ("li", "h")]
MISREAD_DIGITS = {"Z": "2", "z": "2", "l": "1", "I": "1", "|": "1", "b": "6", "S": "5", "s": "5", "B": "8", "O": "0", "o": "0", "D": "0", "q": "9", "g": "9"}
HYPHENS, SURE_HYPHENS = "-‐‑¬­", "¬­"

#: Decisions are sent to all executors if they are at most so many, else they join the texts.
SENT_DECISIONS = 200_000
#: Texts of clean pages that the perceptron is trained on at most, and passes over them.
TRAINING_TEXTS, PASSES, MARGIN = 1500, 8, 1.0
#: Keys that a task holds before it hands its counts on.
HELD_KEYS = 500_000
#: Longer texts are not drawn for training, so that the sample has a bound in letters too.
TRAINING_LETTERS = 20_000

_HAN = re.compile("[" + "".join(k for k in MISREAD_HAN if len(k) == 1) + "".join({v for v in MISREAD_HAN.values() if len(v) == 1}) + "]")
_WORD = re.compile(r"[A-Za-z0-9\u00ec-\u00ef]*[A-Za-z][A-Za-z0-9\u00ec-\u00ef]*")
_FIGURE = re.compile(r"(?<![A-Za-z0-9])(?=[0-9.,ZzlI|bSsBOoDqg]*[0-9])(?=[0-9.,]*[ZzlI|bSsBOoDqg])[0-9ZzlI|bSsBOoDqg][0-9.,ZzlI|bSsBOoDqg]*(?![A-Za-z])")
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
_NUMERALS = {c: i for i, c in enumerate("零一二三四五六七八九")} | {"〇": 0, "○": 0, "两": 2}
_PAGE = re.compile(r"^[\W_]*(?:第|页码|页次|page|pg|p)?[\s.:：]*([0-9lIOoSZBb|]{1,4})\s*(?:页|頁|贞)?[\s,，]*(?:(?:/|\||of|共|／)\s*[0-9lIOoSZBb|]{1,5}\s*(?:页|頁|贞)?)?[\W_]*$", re.IGNORECASE)
_HAN_PAGE = re.compile(r"^[\W_]*第\s*([〇○零一二三四五六七八九十百]{1,5})\s*[页頁贞][\W_]*$")
_ROMAN_PAGE = re.compile(r"^[\W_]*([ivxlc]{1,8})[\W_]*$", re.IGNORECASE)
_SENTENCE = re.compile(r"[。；;！？!?]|[，,：:](?![0-9])|[a-z]\.(?:\s|$)")


#: Parts of a place's key, which begins with its kind: 5 and 3 (windows of characters), w (word), h (hyphenated
#: word), j (hyphen at a line's end), f (figure with letters).
SEP = "\x1f"


def _shape(text: str) -> str:
    return re.sub(r"[0-9０-９]", "0", text)


def _running(lines: list[str]) -> tuple[str, list[int]]:
    """The lines as one text, and where each of them starts in it."""
    starts, size = [], 0
    for line in lines:
        starts.append(size)
        size += len(line)
    return "".join(lines), starts


def window(shape: str, i: int, width: int, center: str | None = None) -> str:
    """Key of the character at i with so many characters on either side."""
    return str(2 * width + 1) + SEP.join((shape[max(0, i - width) : i], center or shape[i], shape[i + 1 : i + 1 + width]))


@dataclass(frozen=True)
class Candidate:
    """One edit of a place: put for `size` characters at `at`; needs: keys whose counts speak for it."""

    action: str
    at: int
    size: int
    put: str
    pair: str
    needs: tuple[str, ...]


def _action(wrong: str, right: str) -> str:
    return "replace" if len(wrong) == len(right) else "delete" if len(wrong) > len(right) else "insert"


def place_candidates(key: str) -> list[Candidate]:
    """What a place could become, in a fixed order."""
    kind, rest = key[0], key[1:]
    if kind == "5":
        left, c, right = rest.split(SEP)
        put = MISREAD_HAN.get(c)
        near = lambda x: "3" + SEP.join((left[-1:], x, right[:1]))
        return [Candidate("replace", 0, 1, put, c + put, ("5" + SEP.join((left, put, right)), near(c), near(put)))] if put else []
    if kind == "j":
        head, hyphen, tail = rest.split(SEP)
        return [Candidate("join", 0, 0, "", hyphen, ("w" + head + tail, f"h{head}-{tail}", "w" + head, "w" + tail))]
    if kind == "f":
        return [Candidate("replace", 0, len(rest), "".join(MISREAD_DIGITS.get(c, c) for c in rest), "", ())]
    found: dict[str, Candidate] = {}
    if kind == "w" and len(rest) >= 3:
        for wrong, right in MISREAD_LATIN:
            at = rest.find(wrong)
            while at >= 0:
                other = rest[:at] + right + rest[at + len(wrong) :]
                found.setdefault(other, Candidate(_action(wrong, right), at, len(wrong), right, f"{wrong}>{right}", ("w" + other,)))
                if any(c.isdigit() for c in other):  # a second misreading in the same word
                    for wrong2, right2 in MISREAD_LATIN:
                        at2 = other.find(wrong2)
                        if at2 >= 0:
                            third = other[:at2] + right2 + other[at2 + len(wrong2) :]
                            found.setdefault(third, Candidate(_action(wrong, right), at, len(wrong), right, f"{wrong}>{right}", ("w" + third,)))
                at = rest.find(wrong, at + 1)
    return list(found.values())


def _log(n: int) -> int:
    return int(math.log2(1 + n))


def features(key: str, own: int, c: Candidate, counts: tuple[int, ...]) -> list[str]:
    """Features of an edit: what it is, and the counts on a scale of powers of two."""
    kind, rest = key[0], key[1:]
    if kind == "5":
        other, near, near_other = (_log(n) for n in counts)
        mine = _log(own)
        return ["han", f"pair {c.pair}", f"b5 {mine}", f"a5 {other}", f"b3 {near}", f"a3 {near_other}", f"d5 {other - mine}", f"d3 {near_other - near}"]
    if kind == "w":
        other, mine = _log(counts[0]), _log(own)
        return ["word", f"latin {c.pair}", f"bw {mine}", f"aw {other}", f"dw {other - mine}", f"more {counts[0] > 4 * own}", f"digit {any(x.isdigit() for x in rest)}", f"short {len(rest) < 5} {other - mine > 2}"]
    if kind == "j":
        whole, two, head, tail = (_log(n) for n in counts)
        return ["join", f"sure {c.pair in SURE_HYPHENS}", f"whole {whole}", f"two {two}", f"dj {max(-4, min(4, whole - two))}", f"parts {head > 2} {tail > 2}", f"both {whole == 0} {two == 0}"]
    form = bool(re.fullmatch(r"[0-9]{1,3}(?:,[0-9]{3})*(?:[.][0-9]+)?[.,]?|[0-9]+(?:[.][0-9]+)?[.,]?", c.put))
    return ["figure", f"digits {sum(x.isdigit() for x in rest) > 1}", f"form {form}"]


@dataclass
class Editor:
    """The averaged perceptron: weights by class and feature."""

    weights: dict[str, float] = field(default_factory=dict)

    def score(self, action: str, names: list[str]) -> float:
        return sum(self.weights.get(f"{action}|{f}", 0.0) for f in names)

    def decide(self, key: str, own: int, counts: list[tuple[int, ...]]) -> int | None:
        """Number of the candidate that scores best, None for keeping; what would become an unknown word is none."""
        best, top = None, self.score("keep", ["place", f"kind {key[0]}"])
        for i, (c, n) in enumerate(zip(place_candidates(key), counts, strict=True)):
            if key[0] == "w" and n[0] == 0:
                continue
            score = self.score(c.action, features(key, own, c, n))
            if score > top:
                best, top = i, score
        return best


def text_places(text: str) -> Iterator[tuple[str, int]]:
    """(key, occurrences to count) of everything in a text that can be edited or speaks for an edit."""
    lines = text.split("\n")
    shape = _shape(_running(lines)[0])
    for m in _HAN.finditer(shape):
        yield window(shape, m.start(), 2), 1
        yield window(shape, m.start(), 1), 1
    ends = [bool(re.search(f"[{HYPHENS}]$", line.rstrip())) for line in lines]
    for n, line in enumerate(lines):
        words = [m.group().lower() for m in _WORD.finditer(line.rstrip())]
        if ends[n]:  # the fragment is no word of its own
            words = words[:-1]
        if n and ends[n - 1]:
            words = words[1:]
        for w in words:
            yield "w" + w, 1
        for m in re.finditer(r"[A-Za-z]+-[A-Za-z]+", line):
            yield "h" + m.group().lower(), 1
        for m in _FIGURE.finditer(line):
            yield "f" + m.group(), 1
    for _n, _k, head, tail, hyphen in _joints(lines):
        yield "j" + SEP.join((head.lower(), hyphen, tail.lower())), 1
        yield "w" + (head + tail).lower(), 0  # so that the joined word is decided too


@dataclass
class Edit:
    line: int
    start: int
    end: int
    right: str


def _next_line(lines: list[str], n: int) -> int | None:
    """The next line of running text that a word can go on in: it starts with a small letter, and only furniture lies between."""
    for k in range(n + 1, len(lines)):
        line = lines[k].strip()
        page = _PAGE.match(line) or _ROMAN_PAGE.match(line) or _HAN_PAGE.match(line)
        if re.match(r"[a-z0-9]", lines[k]) and not page:
            return k
        if line and not page and header_keys(line) is None:
            return None
    return None


def _joints(lines: list[str]) -> Iterator[tuple[int, int, str, str, str]]:
    """(line, next line, head, tail, hyphen) where a line ends in a hyphen and goes on."""
    for n, line in enumerate(lines):
        m = re.search(rf"([A-Za-z0-9]+)([{HYPHENS}])\s*$", line)
        if not m or not re.search("[A-Za-z]", m.group(1)):
            continue
        k = _next_line(lines, n)
        if k is not None:
            tail = re.match(r"[A-Za-z0-9]+", lines[k]).group()
            yield n, k, m.group(1), tail, m.group(2)


#: (place, size, replacement) of a decision; a join has no size.
Decisions = dict[str, tuple[int, int, str]]


def edits(text: str, decided: Decisions) -> tuple[list[Edit], list[tuple[int, int]]]:
    """What to change in a text: (replacements, joints as (line, next line))."""
    lines = text.split("\n")
    whole, starts = _running(lines)
    shape = _shape(whole)
    found: list[Edit] = []
    joined: list[tuple[int, int]] = []
    skip: set[tuple[int, bool]] = set()
    for n, k, head, tail, hyphen in _joints(lines):
        if "j" + SEP.join((head.lower(), hyphen, tail.lower())) in decided:
            joined.append((n, k))
            skip |= {(n, False), (k, True)}
            fix = decided.get("w" + (head + tail).lower())
            if fix:
                at, size, put = fix
                if at < len(head):
                    base = lines[n].rstrip().rfind(head)
                    found.append(Edit(n, base + at, base + at + size, put))
                else:
                    found.append(Edit(k, at - len(head), at - len(head) + size, put))
    for n, line in enumerate(lines):
        for i, c in enumerate(line):
            if c in MISREAD_HAN and (fix := decided.get(window(shape, starts[n] + i, 2))):
                found.append(Edit(n, i, i + 1, fix[2]))
        if not re.search("[A-Za-z|]", line):
            continue
        taken = []
        for m in _FIGURE.finditer(line):
            if fix := decided.get("f" + m.group()):
                found.append(Edit(n, m.start(), m.end(), fix[2]))
                taken.append((m.start(), m.end()))
        words = list(_WORD.finditer(line))
        for j, m in enumerate(words):
            if any(a <= m.start() < b for a, b in taken) or (j == len(words) - 1 and (n, False) in skip) or (j == 0 and m.start() == 0 and (n, True) in skip):
                continue
            if fix := decided.get("w" + m.group().lower()):
                found.append(Edit(n, m.start() + fix[0], m.start() + fix[0] + fix[1], fix[2]))
    return found, joined


#: A place to learn from: its key, and what it should become (None: stay).
Example = tuple[str, str | None]


def training_examples(texts: list[str], seed: int = 11) -> list[Example]:
    """Places of clean texts, and the same with misreadings put in."""
    rng = random.Random(seed)
    stay: set[str] = set()
    rows: list[Example] = []
    wrongs: dict[str, list[str]] = {}
    for wrong, right in MISREAD_HAN.items():
        wrongs.setdefault(right, []).append(wrong)
    back = [(w, r) for w, r in MISREAD_LATIN]
    for text in texts:
        shape = _shape("".join(text.split("\n")))
        for m in _HAN.finditer(shape):
            i, c = m.start(), m.group()
            if c in MISREAD_HAN:
                stay.add(window(shape, i, 2))
            if c in wrongs and rng.random() < 0.3:
                rows.append((window(shape, i, 2, rng.choice(wrongs[c])), c))
        for line in text.split("\n"):
            for m in _WORD.finditer(line):
                word = m.group().lower()
                if len(word) >= 3:
                    stay.add("w" + word)
                if len(word) >= 3 and rng.random() < 0.25:
                    wrong, right = rng.choice(back)
                    at = word.find(right)
                    if at >= 0:
                        rows.append(("w" + word[:at] + wrong + word[at + len(right) :], word))
                if len(word) >= 6 and rng.random() < 0.15:
                    k = rng.randrange(2, len(word) - 2)
                    rows.append(("j" + SEP.join((word[:k], rng.choice(HYPHENS), word[k:])), ""))
                    # a name that stands nowhere else
                    rows.append(("j" + SEP.join((word[:k][::-1] + "q", rng.choice(HYPHENS), "x" + word[k:][::-1])), ""))
            for m in re.finditer(r"([A-Za-z]+)-([A-Za-z]+)", line):
                stay.add("j" + SEP.join((m.group(1).lower(), "-", m.group(2).lower())))
            for m in re.finditer(r"[0-9][0-9,.]*[0-9]", line):
                if rng.random() < 0.1:
                    at = rng.randrange(len(m.group()))
                    wrong = [w for w, r in MISREAD_DIGITS.items() if r == m.group()[at]]
                    if wrong:
                        bad = m.group()[:at] + rng.choice(wrong) + m.group()[at + 1 :]
                        if _FIGURE.fullmatch(bad):
                            rows.append(("f" + bad, m.group()))
            for m in re.finditer(r"(?<![A-Za-z0-9])[0-9]+[A-Za-z](?![A-Za-z0-9])", line):
                if _FIGURE.fullmatch(m.group()):
                    stay.add("f" + m.group())
    # every place once, as it is decided once
    return sorted(set(rows)) + [(key, None) for key in sorted(stay)]


def train_editor(examples: list[Example], counts: dict[str, int], *, passes: int = PASSES, seed: int = 11) -> Editor:
    """Fits the perceptron by its mistakes; weights are averaged over all steps.

    counts: of the examples' keys and of what their candidates need; a key that is missing counts 0.
    What is put in counts at least once, as a misreading in a text does.
    """
    rng = random.Random(seed)
    counts = dict(counts)
    for key, right in examples:
        if right is not None:
            counts[key] = max(1, counts.get(key, 0))
    rows = []
    for key, right in examples:
        own = counts.get(key, 0)
        options, gold = [(["place", f"kind {key[0]}"], "keep")], 0
        for c in place_candidates(key):
            n = tuple(counts.get(k, 0) for k in c.needs)
            if key[0] == "w" and n[0] == 0:
                continue
            if right is not None and gold == 0 and (c.needs[0][1:] == right if key[0] == "w" else True):
                gold = len(options)
            options.append((features(key, own, c, n), c.action))
        if len(options) > 1 and (right is None) == (gold == 0):
            rows.append((options, gold))
    editor, total, step = Editor(), {}, 1
    for _ in range(passes):
        rng.shuffle(rows)
        for options, gold in rows:
            scores = [editor.score(action, names) for names, action in options]
            # another option within the margin is a mistake
            guess = max((i for i in range(len(options)) if i != gold), key=scores.__getitem__)
            if scores[guess] > scores[gold] - MARGIN:
                for i, sign in ((gold, 1.0), (guess, -1.0)):
                    for f in options[i][0]:
                        name = f"{options[i][1]}|{f}"
                        editor.weights[name] = editor.weights.get(name, 0.0) + sign
                        total[name] = total.get(name, 0.0) + sign * step
            step += 1
    editor.weights = {f: w - total[f] / step for f, w in editor.weights.items()}
    return editor


def page_number(line: str, first: int, last: int) -> bool:
    """Whether a line holds only the number of a page from first to last, in any style."""
    s = line.strip()
    if not s or re.fullmatch(r"[（(]\s*[0-9]+\s*[)）]|[-−–]\s*[0-9]+|[0-9]+[.,、:：)）]|[0-9][0-9.,]*[.,][0-9]+|[0-9]+\s*[%％]|注.*|note.*", s, re.IGNORECASE):
        return False
    m = _HAN_PAGE.match(s)
    if m:
        return first <= _han_number(m.group(1)) <= last
    m = _PAGE.match(s)
    if m and (re.search("[0-9]", m.group(1)) or re.fullmatch("[lIO|SZB]+", m.group(1))):
        value = "".join(MISREAD_DIGITS.get(c, c) for c in m.group(1))
        if value.isdigit() and first <= int(value) <= last:
            return True
    m = _ROMAN_PAGE.match(s)
    return bool(m) and first <= _roman(m.group(1).lower()) <= last


def _han_number(s: str) -> int:
    if not any(c in "十百" for c in s):
        return int("".join(str(_NUMERALS.get(c, 0)) for c in s) or 0)
    total, digit = 0, 0
    for c in s:
        if c in "十百":
            total += max(digit, 1) * (10 if c == "十" else 100)
            digit = 0
        else:
            digit = _NUMERALS.get(c, 0)
    return total + digit


def _roman(s: str) -> int:
    values = [_ROMAN[c] for c in s]
    return sum(-v if v < w else v for v, w in zip(values, values[1:] + [0], strict=True))


def _strip_number(line: str) -> str:
    """A header without the page number set beside it."""
    s = line.strip()
    for part in (re.split(r"\s{2,}|\t", s)[0], re.split(r"\s{2,}|\t", s)[-1]):
        rest = s.replace(part, "", 1).strip()
        if rest and part and len(part) >= len(rest) and (_PAGE.match(rest) or _HAN_PAGE.match(rest) or _ROMAN_PAGE.match(rest)):
            return part
    return s


def header_keys(line: str) -> tuple[str, str] | None:
    """(whole, tail) of a line that may be a header: its letters, and the last few of them; digits are one digit."""
    s = _strip_number(line)
    if not s or _SENTENCE.search(s):
        return None
    bare = re.sub(r"[0-9]+", "0", re.sub(r"[\W_]+", "", s)).lower()
    letters = re.sub("0", "", bare)
    if len(letters) < 4 or "\t" in s:
        return None
    return bare, bare[-13:] if bare.isascii() else bare[-5:]


def _apply(line: str, changes: list[Edit]) -> str:
    for e in sorted(changes, key=lambda e: -e.start):
        line = line[: e.start] + e.right + line[e.end :]
    return line


def line_table(text: str, page: int | None, decided: Decisions) -> list[tuple[int, bool, str | None, str | None, bool, bool, bool, bool]]:
    """(line_no, page number, header key, header tail, at the top, goes on, broken, misread) of the lines that show something."""
    lines = text.split("\n")
    found, joined = edits(text, decided)
    changes: dict[int, list[Edit]] = {}
    for e in found:
        changes.setdefault(e.line, []).append(e)
    broken = {n for n, _ in joined}
    out, top = [], True
    for n, line in enumerate(lines):
        if not line.strip():
            continue
        number = page is not None and page_number(line, page, page + 1)
        keys = None if number else header_keys(_apply(line, changes.get(n, [])))
        if number or keys or n in broken or n in changes:
            follows = next((x for x in lines[n + 1 :] if x.strip()), "")
            goes_on = bool(re.match(r"\s*[a-z0-9]", follows)) and not _PAGE.match(follows.strip())
            out.append((n + 1, number, keys[0] if keys else None, keys[1] if keys else None, top, goes_on, n in broken, n in changes))
        top = number
    return out


#: A shape of lines is a header's if so many lines have it, so large a share stands at the top
#: of a page and the next line goes on from at most so large a share.
HEADER_LINES, HEADER_SHARE, HEADER_GOES_ON = 3, 0.6, 0.4

_LINES = "text_id string, line_no int, number boolean, whole string, tail string, top boolean, goes_on boolean, broken boolean, misread boolean"


def _texts(hits: DataFrame) -> DataFrame:
    return hits.where("text is not null").select(_text_id().alias("text_id"), "text", "page_start", "document_key").dropDuplicates(["text_id"])


def count_places(texts: DataFrame) -> DataFrame:
    """(key, n): the places of all texts, counted in the tasks before they are shuffled."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter[str] = Counter()
        for batch in batches:
            for text in batch["text"]:
                for key, n in text_places(text):
                    found[key] += n
                if len(found) > HELD_KEYS:
                    yield pd.DataFrame({"key": list(found), "n": list(found.values())})
                    found = Counter()
        if found:
            yield pd.DataFrame({"key": list(found), "n": list(found.values())})

    return texts.select("text").mapInPandas(count, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))


def fit_editor(texts: DataFrame, page_quality: DataFrame, counts: DataFrame, training_texts: int = TRAINING_TEXTS) -> Editor:
    """The perceptron, fitted on a bounded sample of texts from pages without recognition.

    counts: of all texts (count_places); those of the sample's places are looked up by a join.
    """
    clean = page_quality.where("extraction_route = 'native' and coalesce(ocr_char_count, 0) = 0 and not coalesce(needs_ocr, false)").select("document_key", F.col("page_number").alias("page_start")).distinct()
    usual = texts.where(F.char_length("text") <= TRAINING_LETTERS)
    sample = usual.join(clean, ["document_key", "page_start"]).select("text", "text_id").orderBy("text_id").limit(training_texts).select("text")
    rows = [r["text"] for r in sample.collect()]
    if len(rows) < training_texts // 10:
        rows += [r["text"] for r in usual.select("text", "text_id").orderBy("text_id").limit(training_texts).collect()]
    examples = training_examples(rows)
    keys = {key for key, _ in examples} | {k for key, _ in examples for c in place_candidates(key) for k in c.needs}
    wanted = texts.sparkSession.createDataFrame(pd.DataFrame({"key": sorted(keys)}), "key string")  # the keys of a bounded sample
    known = {r["key"]: r["n"] for r in counts.join(wanted, "key").collect()}
    return train_editor(examples, known)


def decide_places(counts: DataFrame, editor: Editor) -> DataFrame:
    """(key, at, size, put): the places that are to be edited.

    The keys that speak for the candidates join the counts; a place's candidates are as many
    as its own characters allow, so what is gathered for it is short.
    """
    sent = counts.sparkSession.sparkContext.broadcast(editor)  # some hundred weights

    def need(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(key, n, i, j, k) for key, n in zip(batch["key"], batch["n"], strict=True) for i, c in enumerate(place_candidates(key)) for j, k in enumerate(c.needs or ("",))]
            if rows:
                yield pd.DataFrame(rows, columns=["key", "n", "i", "j", "need"])

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, n, told in zip(batch["key"], batch["n"], batch["told"], strict=True):
                options = place_candidates(key)
                values = [[0] * len(c.needs) for c in options]
                for t in told:
                    if options[t["i"]].needs:
                        values[t["i"]][t["j"]] = int(t["m"])
                best = sent.value.decide(key, int(n), [tuple(v) for v in values])
                if best is not None:
                    rows.append((key, options[best].at, options[best].size, options[best].put))
            if rows:
                yield pd.DataFrame(rows, columns=["key", "at", "size", "put"])

    places = counts.where(F.substring("key", 1, 1).isin("5", "w", "j", "f"))
    needed = places.mapInPandas(need, "key string, n long, i int, j int, need string")
    told = needed.join(counts.select(F.col("key").alias("need"), F.col("n").alias("m")), "need", "left").groupBy("key").agg(F.first("n").alias("n"), F.collect_list(F.struct("i", "j", F.coalesce("m", F.lit(0)).alias("m"))).alias("told"))
    return told.mapInPandas(decide, "key string, at int, size int, put string")


def _with_decisions(texts: DataFrame, decided: DataFrame, work: Callable[[pd.DataFrame, Callable[[int], Decisions]], pd.DataFrame], schema: str, sent_decisions: int) -> DataFrame:
    """work over batches of texts, with the decisions that concern each text.

    A bounded number of decisions is sent to all executors; more of them join the texts by the keys of their places.
    """
    if decided.count() <= sent_decisions:
        sent = texts.sparkSession.sparkContext.broadcast({r["key"]: (r["at"], r["size"], r["put"]) for r in decided.collect()})

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield work(batch, lambda _: sent.value)

        return texts.mapInPandas(run, schema)

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, k) for i, t in zip(batch["text_id"], batch["text"], strict=True) for k in {k for k, _ in text_places(t)}]
            if rows:
                yield pd.DataFrame(rows, columns=["text_id", "key"])

    own = texts.select("text_id", "text").mapInPandas(keys, "text_id string, key string").join(decided, "key").groupBy("text_id").agg(F.collect_list(F.struct("key", "at", "size", "put")).alias("decided"))

    def run_joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            told = [{} if d is None else {x["key"]: (x["at"], x["size"], x["put"]) for x in d} for d in batch["decided"]]
            yield work(batch, told.__getitem__)

    return texts.join(own, "text_id", "left").mapInPandas(run_joined, schema)


def _text_id() -> Column:
    return F.sha2(F.to_json(F.struct("text", "page_start"), {"ignoreNullFields": "false"}), 256)


def _noisy_lines(texts: DataFrame, decided: DataFrame, header_lines: int, header_share: float, sent_decisions: int) -> DataFrame:
    """(text_id, line_no, kind) of the distinct texts."""

    def look(batch: pd.DataFrame, decisions: Callable[[int], Decisions]) -> pd.DataFrame:
        rows = []
        for i, (text_id, text, page) in enumerate(zip(batch["text_id"], batch["text"], batch["page_start"], strict=True)):
            rows += [(text_id, *r) for r in line_table(text, None if pd.isna(page) else int(page), decisions(i))]
        return pd.DataFrame(rows, columns=["text_id", "line_no", "number", "whole", "tail", "top", "goes_on", "broken", "misread"])

    lines = cut(_with_decisions(texts.select("text_id", "text", "page_start"), decided, look, _LINES, sent_decisions))
    heads = lines.where("whole is not null")
    shape = F.explode(F.array(F.concat(F.lit("w:"), "whole"), F.concat(F.lit("t:"), "tail"))).alias("shape")
    share = lambda c: F.avg(F.col(c).cast("int"))
    shapes = heads.select(shape, "top", "goes_on").groupBy("shape").agg(F.count("*").alias("n"), share("top").alias("top"), share("goes_on").alias("goes_on"))
    known = shapes.where((F.col("n") >= header_lines) & (F.col("top") >= header_share) & (F.col("goes_on") <= HEADER_GOES_ON)).select("shape")
    keyed = heads.select("text_id", "line_no", shape)
    header = keyed.join(known, "shape").select("text_id", "line_no").distinct().withColumn("header", F.lit(True))
    kinds = F.when(F.col("number"), F.array(F.lit("page_number"))).when(F.col("header"), F.array(F.lit("running_header"))).otherwise(F.array_compact(F.array(F.when(F.col("broken"), F.lit("broken_word")), F.when(F.col("misread"), F.lit("misread")))))
    return lines.join(header, ["text_id", "line_no"], "left").select("text_id", "line_no", F.explode(kinds).alias("kind"))


def _decided(texts: DataFrame, page_quality: DataFrame) -> DataFrame:
    counts = cut(count_places(texts))
    return cut(decide_places(counts, fit_editor(texts, page_quality, counts)))


def find_noise(hits: DataFrame, page_quality: DataFrame, *, header_lines: int = HEADER_LINES, header_share: float = HEADER_SHARE, sent_decisions: int = SENT_DECISIONS) -> DataFrame:
    """(hit_id, line_no, kind): the noisy lines of the hits' texts, counted from 1 at each line feed.

    hits: hit_id, text, page_start, document_key.  Kinds: page_number, running_header,
    broken_word, misread; a line of the first two kinds has no other.  Every distinct text
    is worked on once, however many hits it has; null texts and null hit ids give no row,
    repeated rows count once, and a null page takes no page numbers.
    """
    texts = cut(_texts(hits))
    noisy = _noisy_lines(texts, _decided(texts, page_quality), header_lines, header_share, sent_decisions)
    owners = hits.where("text is not null and hit_id is not null").select("hit_id", _text_id().alias("text_id")).distinct()
    return owners.join(noisy, "text_id").select("hit_id", "line_no", "kind").distinct()


def repair(text: str, decided: Decisions, furniture: set[int]) -> str:
    """The text as continuous paragraphs: furniture gone, misreadings replaced, broken words and wrapped lines joined.

    furniture: numbers of the lines to leave out, from 1.  A paragraph ends at an empty
    line, or where a line that ends a sentence is clearly shorter than the others.
    """
    lines = text.split("\n")
    found, joined = edits(text, decided)
    changes: dict[int, list[Edit]] = {}
    for e in found:
        changes.setdefault(e.line, []).append(e)
    goes = {n for n, _ in joined}
    kept = [(n, _apply(line, changes.get(n, []))) for n, line in enumerate(lines) if n + 1 not in furniture]
    width = sorted(len(x) for _, x in kept if x.strip())
    full = width[len(width) * 3 // 4] if width else 0
    paragraphs, now = [], ""
    for n, line in kept:
        body = line.strip()
        if not body:
            if now and re.search(r"[。！？!?.:：；;]$", now):
                paragraphs.append(now)
                now = ""
            continue
        if n in goes:
            body = body.rstrip(HYPHENS + " ")
        gap = "" if not now or now.endswith("\x00") or not (now[-1].isascii() and body[0].isascii()) or now[-1] == "-" else " "
        now = now.rstrip("\x00") + gap + body + ("\x00" if n in goes else "")
        if re.search(r"[。！？!?.]$", body) and len(line) < 0.8 * full:
            paragraphs.append(now)
            now = ""
    if now:
        paragraphs.append(now.rstrip("\x00"))
    return "\n".join(p.replace("\x00", "") for p in paragraphs)


def repaired_texts(hits: DataFrame, page_quality: DataFrame, *, sent_decisions: int = SENT_DECISIONS) -> DataFrame:
    """(hit_id, repaired_text): the hits' texts as continuous clean paragraphs; null texts stay null."""
    texts = cut(_texts(hits))
    decided = _decided(texts, page_quality)
    noisy = _noisy_lines(texts, decided, HEADER_LINES, HEADER_SHARE, sent_decisions)
    # the furniture of one text: at most as many numbers as the text has lines
    furniture = noisy.where(F.col("kind").isin("page_number", "running_header")).groupBy("text_id").agg(F.collect_set("line_no").alias("furniture"))

    def mend(batch: pd.DataFrame, decisions: Callable[[int], Decisions]) -> pd.DataFrame:
        out = [repair(t, decisions(i), set() if f is None else {int(x) for x in f}) for i, (t, f) in enumerate(zip(batch["text"], batch["furniture"], strict=True))]
        return pd.DataFrame({"text_id": batch["text_id"], "repaired_text": out})

    rows = texts.select("text_id", "text").join(furniture, "text_id", "left")
    mended = _with_decisions(rows, decided, mend, "text_id string, repaired_text string", sent_decisions)
    owners = hits.where("hit_id is not null").select("hit_id", F.when(F.col("text").isNotNull(), _text_id()).alias("text_id")).distinct()
    return owners.join(mended, "text_id", "left").select("hit_id", "repaired_text").distinct()

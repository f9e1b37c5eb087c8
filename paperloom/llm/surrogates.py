"""Personal data replaced by keyed surrogates (operator 4).

Entities are found per text; the distinct ones form a table. Each gets a value of
the same kind and form, drawn from a keyed digest. Values that meet another
entity's value or a real entity are drawn again until all differ, so the mapping
keeps entities apart, and one entity has one value wherever it is named. Names are
found behind a title; the same words without one, anywhere in that text, are mentions
of the same name. A given name has the gender that most titles before it tell.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.batches import utf8
from paperloom.session import cut

REACH = 300  # bytes around a digit, an @ or a title in which an entity must lie
MAX_DRAWS = 64
# Titles by gender (m, f, or u where the title does not tell).
TITLES = {
    "Mr": "m", "Mister": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "господин": "m", "Господин": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Señora": "f", "Sra": "f",
    "госпожа": "f", "Госпожа": "f", "Dr": "u", "Prof": "u",
}
# Given names that surrogates take, by script and gender.
GIVEN = {
    "latin": {
        "m": "Adrian Bruno Cedric Damian Emil Felix Gregor Hugo Ivan Jonas Kilian Lukas Marek Nils Oscar Pavel Rafael Simon Tomas Viktor".split(),
        "f": "Alma Bianca Clara Daria Elena Flora Greta Helena Irena Judith Karla Lena Marta Nadia Olga Petra Rosa Silvia Tamara Vera".split(),
    },
    "cyrillic": {
        "m": "Антон Борис Виктор Глеб Денис Егор Захар Игорь Кирилл Леонид".split(),
        "f": "Алла Вера Галина Дарья Елена Жанна Зоя Ирина Ксения Лидия".split(),
    },
}
SYLLABLES = {
    "latin": ("b d f g h k l m n p r s t v z".split(), "a e i o u".split()),
    "cyrillic": ("б в г д ж з к л м н п р с т".split(), "а е и о у".split()),
}
FEMALE_ENDING = {"latin": "", "cyrillic": "ва"}
MALE_ENDING = {"latin": "", "cyrillic": "в"}
# Signs that issuers begin their access keys with.
KEY_PREFIXES = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "sk_live_", "rk_live_", "xoxb-", "xoxp-")
RESERVED = ("example.com", "example.net", "example.org")  # fixed: domains set aside for examples

TITLE_PATTERN = "|".join(sorted(map(re.escape, TITLES), key=len, reverse=True))
KEY_PATTERN = "|".join(map(re.escape, KEY_PREFIXES))
WORD = r"[^\W\d_](?:[^\W\d_]|['’-](?=[^\W\d_]))*"
ENTITY = re.compile(
    rf"""(?P<email>(?<![\w.%+-])[\w.%+-]{{1,64}}@(?:[A-Za-z0-9-]{{1,63}}\.){{1,8}}[A-Za-z]{{2,24}}(?![\w-]))
    |(?P<ip>(?<![\w.])(?:\d{{1,3}}\.){{3}}\d{{1,3}}(?!\w|\.\d))
    |(?P<ip6>(?<![\w:.])(?=[0-9A-Fa-f]{{0,4}}:)[0-9A-Fa-f:]{{6,39}}(?![\w:]))
    |(?P<iban>(?<!\w)[A-Z]{{2}}\d{{2}}(?:[A-Z0-9]{{11,30}}|(?:[ ][A-Z0-9]{{4}}){{2,7}}(?:[ ][A-Z0-9]{{1,3}})?)(?!\w))
    |(?P<ssn>(?<![\w-])\d{{3}}-\d{{2}}-\d{{4}}(?![\w-]))
    |(?P<card>(?<![\w.+-])(?:\d{{13,19}}|\d{{4}}[ -]\d{{4}}[ -]\d{{4}}[ -]\d{{1,7}}|\d{{4}}[ -]\d{{6}}[ -]\d{{4,5}})(?!\w))
    |(?P<phone>(?<![\w.+])(?:\+\d{{1,3}}[ .-]?)?(?:\(\d{{2,4}}\)|\d{{2,4}})[ .-]?\d{{3,4}}[ .-]\d{{3,4}}(?:[ .-]?\d{{2,4}})?(?!\w))
    |(?P<world>(?<![\w.+])\+\d{{1,15}}(?:[ ./()-]{{1,2}}\d{{1,12}}){{0,6}}(?!\w))
    |(?P<secret>(?<!\w)[0-9A-Fa-f]{{32,128}}(?!\w))
    |(?<!\w)(?:{KEY_PATTERN})(?P<access>[A-Za-z0-9_-]{{16,255}})(?!\w)
    |(?i:password|passwd|secret|api[_-]?key|token)\s*[:=]\s*["']?(?P<key>[^\s"'<>]{{7,127}}[^\s"'<>.,;:!?)])
    |(?<!\w)(?P<title>{TITLE_PATTERN})\.?[ ](?P<name>{WORD}(?:[ ]{WORD}){{0,2}})""",
    re.X,
)
WORDS = re.compile(WORD)
POSSESSIVE = re.compile(r"['’]s$")


def script_of(word: str) -> str:
    return "cyrillic" if "Ѐ" <= word[0] <= "ԯ" else "latin"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def iban_in(value: str) -> str:
    """The longest run of whole groups whose check digits are right; '' if none."""
    while len(value) > 14:
        body = value.replace(" ", "")
        if len(body) <= 34 and int("".join(str(int(c, 36)) for c in body[4:] + body[:4])) % 97 == 1:
            return value
        value = value.rpartition(" ")[0]
    return ""


def phone_in(value: str) -> str:
    """An international number without groups of digits that no longer belong to it."""
    most = 11 if re.match(r"\+1\b", value) else 15  # numbers of the country code 1 have eleven digits
    while sum(c.isdigit() for c in value) > most:
        cut_off = re.sub(r"[ ./()-]+\d+$", "", value)
        if cut_off == value:
            return value
        value = cut_off
    return value


def titled(at: int, value: str, gender: str) -> list[tuple[int, int, str, str]]:
    """The names behind a title: a name goes on while its words are capitalised."""
    run = []
    for w in WORDS.finditer(value):
        if not w.group()[0].isupper():
            break
        run.append((w.start(), POSSESSIVE.sub("", w.group())))
        if run[-1][1] != w.group():
            break
    out = []
    for i, (start, word) in enumerate(run):
        kind = "family" if i == len(run) - 1 else "given"
        sex = gender if kind == "given" or script_of(word) == "cyrillic" else "u"
        out.append((at + start, at + start + len(word), f"{kind}-{sex}-{script_of(word)}", word))
    return out


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of the entities of a text, left to right.

    Names are those behind a title; ``bare`` finds their other mentions.
    """
    out = []
    here = 0
    while m := ENTITY.search(text, here):
        group = m.lastgroup
        value = m.group(group)
        at, end = m.span(group)
        here = max(m.end(), m.start() + 1)
        if group == "email":
            out.append((at, end, "email", value.lower()))
        elif group == "ip":
            if all(int(x) < 256 for x in value.split(".")):
                out.append((at, end, "ip", value))
        elif group == "ip6":
            try:
                form = str(ipaddress.IPv6Address(value))
            except ValueError:
                here = at + 1  # a time or the like: what follows its first sign may be something else
                continue
            if sum(bool(x) for x in form.split(":")) > 2 and re.search(r"\d", form):
                out.append((at, end, "ip6", form))
        elif group == "iban":
            if " " in value:
                value = iban_in(value)
            if value:
                out.append((at, at + len(value), "iban", value.replace(" ", "")))
                here = at + len(value)
            else:
                here = at + 4
        elif group in ("ssn", "phone", "card", "world"):
            value = phone_in(value) if value[0] == "+" else value
            here = at + len(value)
            digits = re.sub(r"\D", "", value)
            kind = "phone" if group == "world" else group
            if kind != "phone" or (8 if group == "world" else 9) <= len(digits) <= 15:
                # The sign of an international number is part of it.
                out.append((at, here, kind, ("+" if value[0] == "+" else "") + digits))
        elif group == "secret":
            if re.search(r"\d", value) and re.search(r"[A-Fa-f]", value):
                out.append((at, end, "hex", value.lower()))
        elif group == "access":
            out.append((at, end, "key", value))
        elif group == "key":
            if re.search(r"\d", value):
                kind, form = ("hex", value.lower()) if re.fullmatch(r"[0-9A-Fa-f]{32,128}", value) else ("key", value)
                out.append((at, end, kind, form))
        elif group == "name":
            out += titled(at, value, TITLES[m.group("title")])
    return out


def bare(text: str, found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Mentions, without a title, of the names among ``found``; anywhere in the text but inside entities."""
    names: dict[str, str] = {}
    for _, _, kind, form in found:
        if "-" in kind and len(form) > 2:
            names.setdefault(form, kind)
    if not names:
        return []
    taken = sorted((a, z) for a, z, *_ in found)
    out, i = [], 0
    for w in WORDS.finditer(text):
        word = POSSESSIVE.sub("", w.group())
        form = word if word in names else word.capitalize() if word.isupper() else ""
        if form not in names:
            continue
        a, z = w.start(), w.start() + len(word)
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if (i == len(taken) or taken[i][0] >= z) and text[max(a - 1, 0) : a] not in ("@", "_") and text[z : z + 1] not in ("@", "_"):
            out.append((a, z, names[form], form))
    return out


class Stream:
    """Numbers below a bound, drawn from a keyed digest of the entity."""

    def __init__(self, key: bytes, kind: str, form: str, draw: int) -> None:
        self.key, self.seed, self.block, self.pool = key, f"{kind}\0{form}\0{draw}".encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hmac.new(self.key, self.seed + self.block.to_bytes(4, "big"), hashlib.sha256).digest()
            self.block += 1
        value, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return value % n

    def like(self, text: str, keep: int = 0) -> str:
        """Letters for letters and digits for digits; the rest, and ``keep`` leading signs, stay."""
        out = list(text)
        for i, c in enumerate(text):
            if i >= keep and c.isdigit():
                out[i] = str(self.below(10))
            elif i >= keep and c.isalpha():
                new = chr(97 + self.below(26))
                out[i] = new.upper() if c.isupper() else new
        return "".join(out)


def surrogate(key: bytes, kind: str, form: str, draw: int) -> str:
    """The ``draw``-th value for an entity: a canonical form of the same kind."""
    s = Stream(key, kind, form, draw)
    if kind == "email":
        local, _, domain = form.partition("@")
        below = domain.split(".")[:-2] or domain.split(".")[:1]
        return f"{s.like(local)}@{'.'.join(s.like(x) for x in below)}.{RESERVED[s.below(3)]}"
    if kind == "ip":
        parts = []
        for x in form.split("."):  # as many digits, until the draws show that there are too few such addresses
            low, high = ((0, 10), (10, 100), (100, 256))[len(x) - 1] if draw < MAX_DRAWS // 2 else (0, 256)
            parts.append(str(low + s.below(high - low)))
        return ".".join(parts)
    if kind == "ip6":  # as many digits in each group
        first, rest = "123456789abcdef", "0123456789abcdef"
        return ":".join("".join((rest if i else first)[s.below(16 if i else 15)] for i in range(len(x))) for x in form.split(":"))
    if kind == "card":
        digits = s.like(form, keep=1)
        if luhn(form):  # a valid number stays valid
            digits = next(digits[:-1] + str(d) for d in range(10) if luhn(digits[:-1] + str(d)))
        return digits
    if kind == "iban":
        body = form[:2] + "00" + s.like(form[4:])
        number = "".join(str(int(c, 36)) for c in body[4:] + body[:4])
        return f"{form[:2]}{98 - int(number) % 97:02d}{body[4:]}"
    if kind == "phone":
        # Country codes stay where the number has more digits than a national one.
        code = max(len(form) - 11, 1) + 1 if form[0] == "+" else 0
        return s.like(form, keep=code)
    if kind == "ssn":
        return s.like(form)
    if kind == "hex":
        return "".join("0123456789abcdef"[s.below(16)] for _ in form)
    if kind == "key":
        return s.like(form)
    what, gender, script = kind.split("-")
    gender = gender if gender != "u" else "mf"[s.below(2)]
    names = GIVEN[script][gender]
    if what == "given" and draw < 4:
        return names[s.below(len(names))]
    onset, vowel = SYLLABLES[script]
    body = "".join(onset[s.below(len(onset))] + vowel[s.below(len(vowel))] for _ in range(3 + draw // 8))
    if what == "given":
        return f"{names[s.below(len(names))]}-{body.capitalize()}"
    return (body + {"f": FEMALE_ENDING, "m": MALE_ENDING}[gender][script]).capitalize() or body


def rendered(kind: str, mention: str, value: str) -> str:
    """The canonical value in the form of one mention: its signs between digits, its case."""
    if kind in ("phone", "card", "ssn"):
        digits = iter(value.lstrip("+"))
        return "".join(next(digits) if c.isdigit() else c for c in mention)
    if kind == "iban":
        signs = iter(value)
        return "".join(c if c == " " else next(signs) for c in mention)
    if mention.isupper():
        return value.upper()
    return value


@lru_cache(maxsize=1)
def signals() -> np.ndarray:
    out = np.zeros(256, bool)
    out[[*range(48, 58), 64]] = True
    return out


def found_in(raw: np.ndarray, off: np.ndarray) -> dict[int, list[tuple[int, int, str, str, str]]]:
    """Per text number with entities: (start, end, kind, form, mention), byte offsets in the text.

    Only stretches around digits, @, titles and key prefixes are searched; every entity
    holds one. Texts with names are then read whole for their other mentions.
    """
    blob = raw.tobytes()
    at = np.flatnonzero(signals()[raw])
    titles = []
    for t in (*TITLES, *KEY_PREFIXES):
        word, i = t.encode(), -1
        while (i := blob.find(word, i + 1)) >= 0:
            titles.append(i)
    at = np.unique(np.concatenate([at, np.array(titles, np.int64)]))
    if not len(at):
        return {}
    row = np.searchsorted(off, at, "right") - 1
    fresh = np.ones(len(at), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (at[1:] - at[:-1] > 2 * REACH)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(at)) - 1
    out: dict[int, list[tuple[int, int, str, str, str]]] = {}

    def keep(r: int, base: int, text: str, plain: bool, got: list[tuple[int, int, str, str]]) -> None:
        for start, end, kind, form in got:
            mention = text[start:end]
            b = start if plain else len(text[:start].encode())
            out.setdefault(r, []).append((base + b, base + b + len(mention.encode()), kind, form, mention))

    for a, z, r in zip(at[first].tolist(), at[last].tolist(), row[first].tolist(), strict=True):
        lo, hi = max(int(off[r]), a - REACH), min(int(off[r + 1]), z + REACH)
        while lo > off[r] and raw[lo] & 0xC0 == 0x80:
            lo -= 1
        while hi < off[r + 1] and raw[hi] & 0xC0 == 0x80:
            hi += 1
        text = blob[lo:hi].decode("utf-8", "replace")
        keep(r, lo - int(off[r]), text, len(text) == hi - lo, entities(text))
    for r in [r for r, got in out.items() if any("-" in kind for _, _, kind, _, _ in got)]:
        whole = blob[off[r] : off[r + 1]]
        text = whole.decode("utf-8", "replace")
        plain = len(text) == len(whole)
        # Where characters begin, to go from bytes to characters and back in one look-up.
        starts = np.append(np.flatnonzero((np.frombuffer(whole, np.uint8) & 0xC0) != 0x80), len(whole))
        place = (lambda b: b) if plain else (lambda b: int(np.searchsorted(starts, b)))
        found = [(place(a), place(z), kind, form) for a, z, kind, form, _ in out[r]]
        for a, z, kind, form in bare(text, found):
            out[r].append((int(starts[a]), int(starts[z]), kind, form, text[a:z]))
        out[r].sort()
    return out


SPANS = "array<struct<start:long,end:long,kind:string,form:string,mention:string>>"


def detected(docs: DataFrame, text: str, want: bool) -> DataFrame:
    """Rows with entities, with a column ``spans`` (byte offsets); or the rows without any."""
    keep = docs.columns
    at = keep.index(text)
    inner = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)])
    fields = ", ".join(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("form", pa.string()), ("mention", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = found_in(*utf8(b.column(f"k{at}")))
            if not want:
                clean = np.ones(b.num_rows, bool)
                clean[list(hit)] = False
                yield b.filter(pa.array(clean))
            elif hit:
                part = b.take(pa.array(sorted(hit), pa.int64()))
                spans = [[dict(zip(("start", "end", "kind", "form", "mention"), x, strict=True)) for x in hit[r]] for r in sorted(hit)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(spans, kind)], names=[*part.schema.names, "spans"])

    out = inner.mapInArrow(run, fields + (f", spans {SPANS}" if want else ""))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *(["spans"] if want else []))


def gendered(spans: DataFrame) -> DataFrame:
    """Kinds of names without the gender, which goes to a column: one name is one entity whatever its title."""
    part = F.split("kind", "-")
    name = F.size(part) == 3
    return spans.withColumn("gender", F.when(name, F.get(part, F.lit(1)))).withColumn(
        "kind", F.when(name, F.concat_ws("-", F.get(part, F.lit(0)), F.get(part, F.lit(2)))).otherwise(F.col("kind"))
    )


def assigned(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, form, value): one surrogate for each distinct entity, all of a kind different.

    A value that equals a real entity or an earlier value is drawn again. The
    smallest form keeps a value that several entities draw at once. A ``gender``
    column (m, f, u or null) tells what a mention says; most mentions decide, a tie
    goes to f, and without any the draw does.
    """

    def draw(n: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                values = []
                for k, f, g in zip(*(b.column(c).to_pylist() for c in ("kind", "form", "gender")), strict=True):
                    what, _, script = k.partition("-")
                    values.append(surrogate(key, f"{what}-{g}-{script}" if script else k, f, n))
                yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("form"), pa.array(values, pa.string())], names=["kind", "form", "value"])

        return run

    if "gender" not in found.columns:
        found = gendered(found)
    he, she = F.count_if(F.col("gender") == "m"), F.count_if(F.col("gender") == "f")
    told = F.when(he > she, "m").when(she > 0, "f").otherwise("u").alias("gender")
    real = cut(found.groupBy("kind", "form").agg(told), "entities")
    pending, done = real, None
    for n in range(MAX_DRAWS):
        tried = pending.mapInArrow(draw(n), "kind string, form string, value string")
        claims = tried.select("kind", "value", F.lit(1).alias("rank"), "form")
        # Names share their values over gender: a value may not stand for two people.
        taken = real.select("kind", F.col("form").alias("value"), F.lit(0).alias("rank"), F.lit("").alias("form"))
        if done is not None:
            taken = taken.unionByName(done.select("kind", "value", F.lit(0).alias("rank"), F.lit("").alias("form")))
        space = F.substring_index("kind", "-", 1).alias("space")
        best = claims.unionByName(taken).groupBy(space, "value").agg(F.min(F.struct("rank", "kind", "form")).alias("b"))
        won = best.filter("b.rank = 1").select("b.kind", "b.form", "value")
        won = cut(won, "surrogates")
        done = won if done is None else done.unionByName(won)
        pending = cut(pending.join(won, ["kind", "form"], "left_anti"), "entities-left")
        if pending.isEmpty():
            return done
    raise RuntimeError(f"no distinct surrogates after {MAX_DRAWS} draws")


def replaced(docs: DataFrame, key: bytes, text: str = "text", out: str = "n_entities") -> DataFrame:
    """All columns of ``docs``, entities of ``text`` replaced, and their number as ``out``.

    Null texts stay null with 0 entities; repeated rows get the same result; an
    existing column ``out`` is replaced. Rows without entities are not exchanged.
    Same key, same corpus: same values; the values of entities that do not
    collide depend on the rest of the corpus only by the gender that the titles tell.
    """
    keep = [c for c in docs.columns if c != out]
    names = [f"k{i}" for i in range(len(keep))]
    at = keep.index(text)
    inner = docs.select(*[F.col(f"`{c}`").alias(n) for n, c in zip(names, keep, strict=True)])
    found = cut(detected(inner, names[at], True), "with-entities").withColumn("text_key", F.md5(names[at]))
    # Copies of a text hold the same entities: one list for each distinct text.
    spans = gendered(found.select("text_key", F.explode("spans").alias("s")).select("text_key", "s.*").distinct())
    values = assigned(spans, key)
    new = F.collect_list(F.struct("start", "end", "kind", "mention", "value")).alias("new")  # of one text
    lists = spans.join(values, ["kind", "form"]).groupBy("text_key").agg(new)
    joined = found.join(lists, "text_key").select(*names, "new")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, count = [], []
            for old, changes in zip(b.column(names[at]).to_pylist(), b.column("new").to_pylist(), strict=True):
                raw, parts, here = old.encode(), [], 0
                for s in sorted(changes, key=lambda s: s["start"]):
                    parts += [raw[here : s["start"]], rendered(s["kind"], s["mention"], s["value"]).encode()]
                    here = s["end"]
                texts.append(b"".join([*parts, raw[here:]]).decode())
                count.append(len(changes))
            cols = [pa.array(texts, pa.string()) if n == names[at] else b.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(count, pa.int64())], names=[*names, "n"])

    fields = ", ".join(f"{n} {inner.schema[n].dataType.simpleString()}" for n in names)
    changed = joined.mapInArrow(run, f"{fields}, n long")
    plain = detected(inner, names[at], False).withColumn("n", F.lit(0).cast("long"))
    both = plain.unionByName(changed)
    return both.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], F.col("n").alias(out))

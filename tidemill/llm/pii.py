"""Surrogates for personal data.

Entities (e-mail addresses, phone numbers, card numbers, IPv4 addresses, named persons) are replaced by
keyed surrogates of the same type and format: digits and letters are permuted or drawn by a keyed hash,
names come from lists of the same gender and script. The same entity gets the same surrogate in every
document; short and full mentions of a name share its surname's surrogate. A table of all distinct entities is checked: where two would share a surrogate, or one would
get another's real value, all but one draw again, until all differ; later draws are longer, so that names,
e-mail addresses and phone numbers don't run out. Card, SSN and IPv4 formats have a fixed number of values.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

# Titles with the gender they tell, and given names and surnames by gender and script.
TITLES = {
    "mr": "m", "herr": "m", "señor": "m", "sr": "m", "monsieur": "m", "sir": "m", "господин": "m",
    "mrs": "f", "ms": "f", "miss": "f", "frau": "f", "señora": "f", "sra": "f", "madame": "f", "mme": "f", "госпожа": "f",
    "dr": "n", "prof": "n",
}
GIVEN = {
    ("latin", "m"): "James John Robert Michael David Thomas Peter Paul Daniel Martin Lukas Felix Jonas Pierre Louis Hugo Carlos Miguel Javier Diego".split(),
    ("latin", "f"): "Mary Anna Laura Emma Julia Sarah Clara Helen Nora Lisa Marie Sophie Camille Chloe Lucia Carmen Elena Sofia Ingrid Greta".split(),
    ("cyrillic", "m"): "Иван Пётр Сергей Андрей Николай Дмитрий Алексей Михаил".split(),
    ("cyrillic", "f"): "Анна Мария Ольга Елена Ирина Наталья Татьяна Светлана".split(),
}
SURNAMES = {
    "latin": "Ashdown Barlow Carver Denholm Ellery Farrow Garland Hollis Ingram Jarvis Kendal Lorimer Marlow Norwood Osborne Pemberton Quimby Radley Selwyn Thackery Underhill Venning Wexford Yardley Bergmann Dreyer Falk Hartwig Keller Lindner Moser Reuter Aubert Blanchet Chevrel Duvall Fontaine Garnier Alarcon Benitez Cordero Escobar Fuentes Galindo".split(),
    "cyrillic": "Белов Волков Громов Данилов Ершов Жуков Зимин Калинин".split(),
}

#: Syllables of surnames beyond the lists: consonants, vowels, ending. Ten have over 10 ** 18 values.
SYLLABLES = {"latin": ("bdfgklmnprstvz", "aeiou", "n"), "cyrillic": ("бвгдзклмнпрстф", "аеиоу", "нов")}
MOST_SYLLABLES = 10
LONGER_PHONE = 12  # the attempt from which phone numbers get further digits

_TITLE = "|".join(sorted(TITLES, key=len, reverse=True))
# Python's (?i) takes these letters for s and i; Java's (?iu) need not.
_NEXT = re.compile(r" +([A-ZÀ-ÞА-ЯЁ][\w'-]+)")
_TITLE_ANY = _TITLE.replace("s", "[sſ]").replace("i", "[iıİ]")
PATTERNS = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")),
    ("ip", re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)")),
    ("phone", re.compile(r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\d)|(?<!\w)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])")),
    ("card", re.compile(r"(?<![\d.])(?:2[2-7]|[3-6]\d)\d{2}(?:[ -]?\d{4}){3}(?!\d)|(?<![\d.])3[47]\d{2}[ -]?\d{6}[ -]?\d{5}(?!\d)")),
    ("ssn", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")),
    ("name", re.compile(rf"\b(?i:({_TITLE}))\b\.? +([A-ZÀ-ÞА-Я][\w'-]+)(?: +([A-ZÀ-ÞА-Я][\w'-]+))?")),
]
#: Rows that may have an entity: a digit (two late Unicode blocks by number), an at sign or a title.
MAYBE = rf"(?iu)[\p{{Nd}}\x{{11F50}}-\x{{11F59}}\x{{1E4F0}}-\x{{1E4F9}}@]|(^|[^\p{{L}}])({_TITLE_ANY})[. ]"


def _luhn(digits: str) -> str:
    total = sum(sum(divmod(2 * int(d), 10)) if k % 2 == 0 else int(d) for k, d in enumerate(reversed(digits)))
    return str(-total % 10)


def _gender(title: str) -> str:
    return TITLES[title.lower().replace("ſ", "s").replace("ı", "i").replace("i\u0307", "i")]


def detect(text: str | None) -> list[tuple[int, int, str, str]]:
    """(from, to, type, canonical value) of the entities, from left to right, none inside another.

    A name found after a title is found without one as well, in full or by its surname, anywhere in the text.
    Mentions of a full name whose title tells no gender have the gender that another mention's title tells.
    """
    text, found = text or "", []
    taken = bytearray(len(text))
    for kind, pattern in PATTERNS:
        for m in pattern.finditer(text):
            lo, hi = (m.start(2), m.end(3) if m.group(3) else m.end(2)) if kind == "name" else m.span()
            if kind == "name" and text[hi - 2 : hi] in ("'s", "'S") and hi - 2 > lo:
                hi -= 2
            if any(taken[lo:hi]):
                continue
            if kind == "card" and _luhn((digits := re.sub(r"\D", "", text[lo:hi]))[:-1]) != digits[-1]:
                continue  # a number like another
            taken[lo:hi] = b"\1" * (hi - lo)
            value = text[lo:hi]
            if kind == "name":
                canon = f"{_gender(m.group(1))}:{value}"
            elif kind == "email":
                canon = value.lower()
            elif kind == "ip":
                canon = ".".join(str(int(p)) for p in value.split("."))
            else:
                canon = re.sub(r"\D", "", value)
            found.append((lo, hi, kind, canon))
    names = [c for _, _, k, c in found if k == "name"]
    if names:
        found = _bare(text, found, names, taken)
    return sorted(found)


def _bare(text: str, found: list, names: list[str], taken: bytearray) -> list:
    """found with the mentions of the names without a title, and one gender for each full name if titles agree."""
    genders: dict[tuple, set] = {}
    for canon in names:
        genders.setdefault(_words(canon), set()).add(canon[0])
    told = {words: g.pop() if len(g := known - {"n"}) == 1 else "n" for words, known in genders.items()}
    one = lambda canon: f"{told[_words(canon)]}{canon[1:]}" if canon[0] == "n" else canon
    found = [(lo, hi, kind, one(canon) if kind == "name" else canon) for lo, hi, kind, canon in found]
    wanted = set(told) | {words[-1:] for words in told}
    for m in re.finditer(r"[A-ZÀ-ÞА-ЯЁ][\w'-]+", text):  # words, looked up: linear whatever the number of names
        first = m.group().removesuffix("'s").removesuffix("'S")
        after = _NEXT.match(text, m.end())
        second = after.group(1).removesuffix("'s").removesuffix("'S") if after else ""
        for words, hi in (((first, second), after and after.start(1) + len(second)), ((first,), m.start() + len(first))):
            words = tuple(w.lower() for w in words)
            if second and len(words) == 2 or len(words) == 1:
                start = m.start()
                if words in wanted and not any(taken[start:hi]) and (not start or not re.match(r"\w", text[start - 1])):
                    taken[start:hi] = b"\1" * (hi - start)
                    found.append((start, hi, "name", f"{told.get(words, 'n')}:{text[start:hi]}"))
                    break
    return found


def _words(canon: str) -> tuple[str, ...]:
    """The words of a name in lower case."""
    return tuple(canon[2:].lower().split())


def parts(kind: str, canon: str) -> list[tuple[str, str]]:
    """(kind, canonical value) of what is drawn for an entity: of a name its surname, alike in short and full
    mentions, and its given name as one with the surname."""
    if kind != "name":
        return [(kind, canon)]
    words = _words(canon)
    return [("surname", words[-1])] + ([("given", f"{canon[0]}:{' '.join(words)}")] if len(words) > 1 else [])


def _draw(key: str, *parts) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode(), key=key.encode()[:64], digest_size=16).digest(), "big")


def _permute(digits: str, key: str, kind: str, attempt: int) -> str:
    """A keyed permutation of the digit strings of one length."""
    if len(digits) < 2:
        return str((int(digits) + _draw(key, kind, attempt) % 9 + 1) % 10) if digits else ""
    half = len(digits) // 2
    a, b = digits[:half], digits[half:]
    for r in range(8):
        a, b = b, str((int(a) + _draw(key, kind, attempt, r, len(digits), b)) % 10 ** len(a)).zfill(len(a))
    return a + b


def _surname(draw: int, script: str, attempt: int) -> str:
    """A surname from the list, then two with a hyphen, then one of more and more drawn syllables."""
    names = SURNAMES[script]
    draw, first = divmod(draw, len(names))
    if attempt < 2:
        return names[first] + (f"-{names[draw % len(names)]}" if attempt else "")
    consonants, vowels, end = SYLLABLES[script]
    out = []
    for _ in range(min(attempt + 1, MOST_SYLLABLES)):
        draw, k = divmod(draw, len(consonants) * len(vowels))
        out.append(consonants[k % len(consonants)] + vowels[k // len(consonants)])
    return "".join(out).capitalize() + end


def surrogate(kind: str, canon: str, key: str, attempt: int = 0) -> str:
    """The canonical surrogate: of the same type, length and check digit; the gender and script of a name."""
    if kind == "email":
        local, domain = canon.rsplit("@", 1)
        seed = _draw(key, kind, attempt, canon)
        out = []
        for c in local:
            seed, k = divmod(seed, 26) if seed > 1 << 20 else (_draw(key, kind, attempt, canon, len(out)), 7)
            out.append(chr(97 + k) if c.isalpha() else str(k % 10) if c.isdigit() else c)
        longer = _draw(key, "longer", attempt, canon)
        for _ in range(min(2 * attempt, 24)):
            longer, k = divmod(longer, 26)
            out.append(chr(97 + k))
        labels = domain.split(".")
        host = [re.sub(r"\d", lambda m: str(_draw(key, "host", domain, m.start()) % 10), p) for p in labels[:-2]]
        return "".join(out) + "@" + ".".join([*host, "example", "org" if labels[-1] != "org" else "net"])
    if kind == "ip":
        a, b = (int.from_bytes(bytes(map(int, canon.split(".")[k : k + 2])), "big") for k in (0, 2))
        for r in range(8):
            a, b = b, (a + _draw(key, kind, attempt, r, b)) % (1 << 16)
        return ".".join(map(str, [*a.to_bytes(2, "big"), *b.to_bytes(2, "big")]))
    if kind == "card":
        body = canon[0] + _permute(canon[1:-1], key, kind, attempt)
        return body + _luhn(body)
    script = "cyrillic" if re.search("[А-яЁё]", canon) else "latin"
    if kind == "surname":
        return _surname(_draw(key, kind, attempt, canon), script, attempt)
    if kind == "given":  # with the surname as it was: names of one surname must differ
        gender, words = canon[0], _words(canon)
        draw, k = divmod(_draw(key, kind, attempt, canon), 2)
        given = GIVEN[script, gender if gender in "mf" else "mf"[k]]
        new = given[draw % len(given)]
        if attempt >= 2:
            new += "-" + _surname(draw >> 20, script, attempt).removesuffix(SYLLABLES[script][2])
        return f"{gender}:{new} {words[-1]}"
    if kind == "name":
        drawn = [surrogate(k, c, key, attempt) for k, c in parts(kind, canon)]
        return compose(canon, *drawn)
    if kind == "phone" and attempt >= LONGER_PHONE:  # so many numbers of this length that it has too few values
        more = min(attempt - LONGER_PHONE + 1, 12)
        return surrogate(kind, canon, key) + str(_draw(key, "longer", attempt, canon) % 10**more).zfill(more)
    if kind == "phone" and len(canon) > 7:
        return canon[:-7] + _permute(canon[-7:], key, kind + canon[:-7], attempt) if len(canon) < 10 else canon[:-10] + _permute(canon[-10:], key, kind + canon[:-10], attempt)
    return _permute(canon, key, kind, attempt)


def compose(canon: str, surname: str, given: str | None = None) -> str:
    """The surrogate of a name from those of its parts."""
    feminine = canon[0] == "f" or canon[0] == "n" and canon.lower()[-1] in "ая"
    last = surname + ("а" if feminine and re.search("[А-яЁё]", surname) else "")
    return f"{canon[0]}:" + (f"{given[2:].split()[0]} {last}" if given else last)


def dress(value: str, kind: str, new: str) -> str:
    """The surrogate in the format of the value: its separators, its letter case."""
    if kind == "name":
        new = new.partition(":")[2]
        return new.upper() if value.isupper() else new
    if kind == "email":
        return new.upper() if value.isupper() else new
    if kind == "ip":
        return new
    digits = iter(new)
    return "".join([next(digits) if c.isdigit() else c for c in value] + [*digits])


def replace(text: str | None, key: str, attempts: dict[tuple[str, str], int] | None = None) -> tuple[str | None, int]:
    """The text with surrogates, and the number of entities."""
    spans = detect(text)
    if not spans:
        return text, 0
    out, at, attempts = [], 0, attempts or {}
    for lo, hi, kind, canon in spans:
        drawn = [surrogate(k, c, key, attempts.get((k, c), 0)) for k, c in parts(kind, canon)]
        out += [text[at:lo], dress(text[lo:hi], kind, compose(canon, *drawn) if kind == "name" else drawn[0])]
        at = hi
    return "".join([*out, text[at:]]), len(spans)


def _entities(text):
    @F.pandas_udf("array<struct<kind: string, canon: string>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"kind": k, "canon": c} for k, c in sorted({p for _, _, k, c in detect(t) for p in parts(k, c)})])

    return run(text)


def _surrogates(key: str):
    @F.pandas_udf("string")
    def run(kind: pd.Series, canon: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([surrogate(k, c, key, int(a)) for k, c, a in zip(kind, canon, attempt)], dtype="object")

    return run


def _written(value):
    """How a surrogate or an entity looks in a text: a name without its gender and in lower case, and of a
    Cyrillic surname the form without the feminine ending."""
    name = F.lower(F.regexp_replace(value, "^[mfn]:", ""))
    return F.when(F.col("kind") == "surname", F.regexp_replace(name, "а$", "")).when(F.col("kind").isin("name", "given"), name).otherwise(value)


def settle(entities: DataFrame, key: str, scratch: Scratch, rounds: int = 40) -> DataFrame:
    """(kind, canon, attempt, surrogate) of all distinct entities or parts (kind, canon), with all surrogates of a
    kind, as written, different from one another and from the entities themselves."""
    draw = _surrogates(key)
    table = scratch.save(entities.withColumn("attempt", F.lit(0)).withColumn("surrogate", draw("kind", "canon", F.lit(0))), "surrogates-0")
    for i in range(1, rounds + 1):
        written = table.withColumn("form", _written(F.col("surrogate")))
        owners = written.groupBy("kind", "form").agg(F.min("canon").alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1")
        shared = written.join(owners, ["kind", "form"]).where("canon != owner").select("kind", "canon")
        real = table.select("kind", _written(F.col("canon")).alias("form")).distinct()
        taken = written.join(real, ["kind", "form"], "left_semi").select("kind", "canon")
        again = scratch.save(shared.union(taken).distinct(), f"again-{i}")
        if again.isEmpty():
            return table
        redo = table.join(again, ["kind", "canon"]).select("kind", "canon", (F.col("attempt") + 1).alias("attempt"))
        kept = table.join(again, ["kind", "canon"], "left_anti")
        table = scratch.save(kept.unionByName(redo.withColumn("surrogate", draw("kind", "canon", "attempt"))), f"surrogates-{i}")
    raise RuntimeError(f"surrogates still collide after {rounds} rounds: a format of fixed length has nearly all its values in use")


def anonymise(docs: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """docs with pii_text (the text with surrogates) and pii_count (entities replaced).

    docs needs doc_id and text; result columns replace columns of the same name; others pass through. A
    null text stays null, with count 0; texts without entities come back as they were; rows of one id are
    rewritten one by one, equal rows equally; an empty table gives an empty table.
    """
    row_key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text"))
    maybe = docs.where(F.coalesce(F.col("text").rlike(MAYBE), F.lit(False)))
    mentions = maybe.select(row_key.alias("_pii_key"), F.explode(_entities(F.col("text"))).alias("e")).select("_pii_key", "e.*")
    mentions = scratch.save(mentions, "mentions")
    table = settle(mentions.select("kind", "canon").distinct(), key, scratch)
    redrawn = mentions.join(table.where("attempt > 0").select("kind", "canon", "attempt"), ["kind", "canon"]).distinct()
    by_row = redrawn.groupBy("_pii_key").agg(F.collect_list(F.struct("kind", "canon", "attempt")).alias("_pii_redrawn"))  # a row's own entities
    by_row = scratch.save(by_row, "redrawn")

    @F.pandas_udf("text string, n long")
    def rewrite(texts: pd.Series, redrawn: pd.Series) -> pd.DataFrame:
        out = [replace(t, key, {(r["kind"], r["canon"]): r["attempt"] for r in ([] if rs is None else rs)}) for t, rs in zip(texts, redrawn)]
        return pd.DataFrame(out, columns=["text", "n"])

    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("pii_text", "pii_count")]
    joined = docs.select(*kept, row_key.alias("_pii_key")).join(by_row, "_pii_key", "left")
    done = joined.withColumn("_pii", rewrite(F.when(F.col("text").rlike(MAYBE), F.col("text")), F.col("_pii_redrawn")))
    return done.select(*kept, F.when(F.col("_pii.n") > 0, F.col("_pii.text")).otherwise(F.col("text")).alias("pii_text"), F.coalesce("_pii.n", F.lit(0)).alias("pii_count"))

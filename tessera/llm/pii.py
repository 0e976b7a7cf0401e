"""PII surrogates: detected entities get keyed, type-consistent replacements, the same for the same entity everywhere.

Kinds: email, IPv4 address, card or account number, IBAN, phone, social security number, and names of people that a title or a
phrase introduces, whose later mentions in the text count too. An entity is what identifies: an e-mail's local part and its
domain, a number's digits, a given or a family name. So `Mr Smith` and `John Smith` keep the family name in common, and equal
numbers written with other separators stay equal.

Replacements come from HMAC-SHA256 of the key, kind and entity. They keep length, separators, case and character class; cards
keep the Luhn property, IBANs have right check digits, addresses stay private, loopback, link-local or public, phones keep their
country code and punctuation;
given names keep gender and script (Latin, Cyrillic or Greek), as do family names.

Distinctness: all different entities of the corpus are gathered in a table, and a replacement that two of them share, or that
is itself an entity of the corpus, is drawn again for all but the first, until no collision is left. Where a form has no room left
(a corpus with every number of a short form) a surrogate gets longer, an address leaves its class, so the rounds end. Only entities that were drawn again need looking up when documents are
rewritten: up to `few` of them are broadcast, more are joined to the documents that mention them.

Defined results: null text stays null; empty texts stay empty; overlapping finds go to the kind listed first; repeated rows are
rewritten alike; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stage

# What introduces a name, with the gender it tells.
TITLES = {
    "Mr": "m", "Mister": "m", "Sir": "m", "Herr": "m", "Herrn": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Don": "m", "Signor": "m", "господин": "m", "Господин": "m", "Κύριος": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Madam": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mlle": "f", "Señora": "f", "Sra": "f", "Señorita": "f", "Doña": "f", "Signora": "f", "госпожа": "f", "Госпожа": "f", "Κυρία": "f",
    "Dr": "", "Prof": "", "Professor": "", "Doktor": "", "Docteur": "", "Doctor": "",
    "my name is": "", "My name is": "", "mein Name ist": "", "Mein Name ist": "", "je m'appelle": "", "Je m'appelle": "", "me llamo": "", "Me llamo": "", "меня зовут": "", "Меня зовут": "",
}
# Common given names, for gender where no title tells it.
GIVEN = {
    "f": "Anna Maria Mary Emma Julia Laura Sarah Susan Linda Elena Sofia Olga Natalia Claire Marie Sophie Carmen Lucia Ana Katharina Petra Jane Alice Анна Мария Елена Ольга Наталья Μαρία Ελένη".split(),
    "m": "John James Robert Michael David Peter Paul Thomas Hans Klaus Juan Jose Carlos Luis Pierre Jean Michel Jacques Ivan Sergei Dmitri Mark Luke Иван Сергей Дмитрий Алексей Γιώργος Νίκος".split(),
}
# Syllables and endings of made-up names by script.
SYLLABLES = {
    "latin": ("ba be bo da de do fa fe ga ka ke la le lo ma me mi na ne no pa pe ra re ri ro sa se ta te ti va ve vi zo".split(), {"f": ["na", "la", "ra", "lia", "ria"], "m": ["n", "s", "ro", "ldo", "rt"], "": ["ner", "son", "man", "ley", "ton"]}),
    "cyrillic": ("ба бе бо да де до га ка ке ла ле ло ма ме ми на не но па пе ра ре ри ро са се та те ти ва ве ви зо".split(), {"f": ["на", "ла", "рия", "лия"], "m": ["н", "слав", "мир", "р"], "": ["ненко", "рук", "дзе", "ян"]}),
    "greek": ("βα βε βο δα δε δο κα κε λα λε λο μα με μι να νε νο πα πε ρα ρε ρι ρο σα σε τα τε τι".split(), {"f": ["να", "λα", "ρία", "νη"], "m": ["νος", "ρης", "λος", "κης"], "": ["ίδης", "άκης", "όπουλος", "ίου"]}),
}

_TITLE = "|".join(sorted(map(re.escape, TITLES), key=len, reverse=True))
_CAPITALISED = r"(?:[^\W\d_a-zа-яα-ω][^\W\d_]+)"
NAME = re.compile(rf"\b({_TITLE})\.?[  ]+({_CAPITALISED}(?:[ -]{_CAPITALISED}){{0,2}})")
#: The end of an e-mail's local part, reversed, and its domain.
_LOCAL_END = re.compile(r"(?:[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*)?")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_MENTION = re.compile(r"\w+")
#: Numbers; e-mails claim their place first, then these in the order of NUMBERS, then names.
KINDS = {
    "ip": re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)", re.ASCII),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", re.ASCII),
    "card": re.compile(r"(?<![\dA-Za-z])\d(?:[ -]?\d){12,18}(?![\dA-Za-z])", re.ASCII),
    "ssn": re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", re.ASCII),
    "phone": re.compile(r"(?<![\dA-Za-z])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\dA-Za-z])", re.ASCII),
}
_CUES = tuple({t.split()[0] for t in TITLES})


def luhn(digits: str) -> int:
    """What the Luhn sum leaves modulo 10; 0 for a right number."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10


def iban_check(text: str) -> int:
    """98 less the remainder: the check digits of an IBAN whose own are taken as 00."""
    body = text[4:] + text[:2] + "00"
    return 98 - int("".join(str(int(c, 36)) for c in body)) % 97


def script_of(word: str) -> str:
    c = word[:1]
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin"


class Draw:
    """A stream of keyed numbers for one entity and attempt."""

    def __init__(self, key: bytes, kind: str, entity: str, attempt: int):
        self.seed = hmac.new(key, f"{kind}\0{entity}\0{attempt}".encode(), hashlib.sha256).digest()
        self.block, self.pool = 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hashlib.sha256(self.seed + self.block.to_bytes(4, "big")).digest()
            self.block += 1
        value, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return value % n

    def shaped(self, text: str) -> str:
        """Digits for digits, letters for letters of the same case, all else as it is."""
        return "".join(str(self.below(10)) if c.isdigit() else chr(97 + self.below(26)) if "a" <= c <= "z" else chr(65 + self.below(26)) if "A" <= c <= "Z" else c for c in text)


def _name(draw: Draw, kind: str, entity: str, grown: int) -> str:
    syllables, endings = SYLLABLES[script_of(entity)]
    end = endings[{"given_f": "f", "given_m": "m"}.get(kind, "")]
    word = "".join(syllables[draw.below(len(syllables))] for _ in range(2 + grown)) + end[draw.below(len(end))]
    return word.upper() if len(entity) > 1 and entity.isupper() else word.capitalize()


#: Blocks of addresses that aren't public: class, then first and last octets of the prefix.
IP_CLASSES = {"private10": (10,), "private172": (172, (16, 31)), "private192": (192, 168), "loopback": (127,), "linklocal": (169, 254)}
#: The attempt from which a number's form is taken to have no room left.
LATER = 16


def ip_class(address: str) -> str:
    octets = [int(x) for x in address.split(".")]
    fits = lambda want, have: want == have if isinstance(want, int) else want[0] <= have <= want[1]
    return next((name for name, prefix in IP_CLASSES.items() if all(map(fits, prefix, octets))), "public")


def _address(draw: Draw, kind: str) -> str:
    while True:
        octets = [draw.below(256) for _ in range(4)]
        for i, want in enumerate(IP_CLASSES.get(kind, ())):
            octets[i] = want if isinstance(want, int) else want[0] + draw.below(want[1] - want[0] + 1)
        out = ".".join(map(str, octets))
        if ip_class(out) == kind and (kind != "public" or 0 < octets[0] < 224):
            return out


def surrogate(key: bytes, kind: str, entity: str, attempt: int = 0) -> str:
    """The replacement of an entity in canonical form; never the entity itself. Names and e-mails are a character longer with each
    eighth attempt, numbers a digit longer from the attempt LATER on, when addresses leave their class."""
    draw, grown, longer = Draw(key, kind, entity, attempt), attempt // 8, max(0, attempt - LATER + 8) // 8
    while True:
        if kind in ("given_f", "given_m", "family"):
            out = _name(draw, kind, entity, grown)
        elif kind == "email_local":
            out = draw.shaped(entity) + "".join(chr(97 + draw.below(26)) for _ in range(grown))
        elif kind == "email_domain":
            body, _, top = entity.rpartition(".")
            out = f"{draw.shaped(body)}{''.join(chr(97 + draw.below(26)) for _ in range(grown))}.{top}"
        elif kind == "ip":
            out = _address(draw, ip_class(entity) if attempt < LATER else "public")
        elif kind == "iban":
            out = entity[:2] + "00" + draw.shaped(entity[4:]) + draw.shaped("0" * longer)
            out = f"{out[:2]}{iban_check(out):02d}{out[4:]}"
        elif kind == "card":
            out = draw.shaped(entity + "0" * longer)
            if luhn(entity) == 0:
                out = out[:-1] + str((10 - luhn(out[:-1] + "0")) % 10)
        elif kind == "phone" and entity.startswith("+"):  # country code and digits
            code, _, rest = entity.partition(" ")
            out = f"{code} {draw.shaped(rest + '0' * longer)}"
        else:
            out = draw.shaped(entity + "0" * longer)
        if out != entity or (attempt and not any(c.isalnum() for c in entity)):
            return out


def _fill(shape: str, digits: str) -> str:
    """shape with its letters and digits taken from digits in order; what is left of digits follows."""
    it = iter(digits)
    return "".join(next(it) if c.isalnum() and c.isascii() else c for c in shape) + "".join(it)


def _phone(text: str) -> str:
    """Canonical form: +country digits where the country is told, else the digits."""
    if not text.startswith("+"):
        return re.sub(r"\D", "", text)
    code = re.match(r"\+\d{1,3}", text)[0]
    cut = re.match(r"\+\d{1,3}(?=[ .(-])", text)
    code = cut[0] if cut else code
    return f"{code} {re.sub(r'[^0-9]', '', text[len(code):])}"


def gender_of(given: str, title: str) -> str:
    g = TITLES.get(title, "")
    return g or ("m" if given in GIVEN["m"] else "f" if given in GIVEN["f"] or given[-1:] in "aаα" else "m")


def emails(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, at sign, end) of every address, from left to right. Each part of the text is read once, whatever it holds."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = _LOCAL_END.match(text[done:at][::-1]).end() if at > done else 0
        domain = _DOMAIN.match(text, at + 1)
        if start and domain:
            yield at - start, at, domain.end()
            done = domain.end()
        else:
            done = at + 1
        at = text.find("@", max(done, at + 1))


def _whole(_: str) -> bool:
    return True


def _right_iban(s: str) -> bool:
    plain = s.replace(" ", "")
    return int(plain[2:4]) == iban_check(plain)


#: Per kind of a number: what a match must hold, and its canonical form.
NUMBERS = {
    "ip": (_whole, str), "iban": (_right_iban, lambda s: s.replace(" ", "")), "phone": (_whole, _phone),
    "card": (_whole, lambda s: re.sub(r"\D", "", s)), "ssn": (_whole, lambda s: re.sub(r"\D", "", s)),
}


def introduced(text: str) -> dict[str, str]:
    """Name -> kind, of the people that titles and phrases introduce."""
    names: dict[str, str] = {}
    for m in NAME.finditer(text):
        words = re.split("[ -]", m[2])
        given = words[:-1] if len(words) > 1 or not m[1].lower().endswith(("name is", "ist", "appelle", "llamo", "зовут")) else words
        gender = gender_of(given[0] if given else "", m[1])
        for w in given:
            names.setdefault(w, f"given_{gender}")
        if len(given) < len(words):
            names.setdefault(words[-1], "family")
    return names


def find(text: str) -> list[tuple[int, int, str, list[tuple[str, str]]]]:
    """(start, end, kind, entities) in order, none overlapping; entities: (kind, canonical form), those whose surrogates make up the replacement."""
    found: list[tuple[int, int, str, list[tuple[str, str]]]] = []

    def claim(fresh: Iterable[tuple[int, int, str, list[tuple[str, str]]]]) -> None:
        """Adds what overlaps nothing that an earlier kind claimed; both lists are in order, so one walk tells."""
        nonlocal found
        i, free = 0, []
        for f in fresh:
            while i < len(found) and found[i][1] <= f[0]:
                i += 1
            if i == len(found) or found[i][0] >= f[1]:
                free.append(f)
        if free:
            found = sorted(found + free, key=lambda f: f[0])

    if re.search(r"[0-9@]", text):
        claim((a, b, "email", [("email_local", text[a:at]), ("email_domain", text[at + 1 : b].lower())]) for a, at, b in emails(text))
        for kind, (holds, plain) in NUMBERS.items():
            claim((*m.span(), kind, [(kind, plain(m[0]))]) for m in KINDS[kind].finditer(text) if holds(m[0]))
    if any(c in text for c in _CUES) and (names := introduced(text)):
        claim((*m.span(), "name", [(names[m[0]], m[0])]) for m in _MENTION.finditer(text) if m[0] in names)
    return found


def replace(text: str, look_up: Callable[[str, str], str]) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with its entities' surrogates, and the spans in the original."""
    out, at, spans = [], 0, []
    for a, b, kind, entities in find(text):
        new = [look_up(k, e) for k, e in entities]
        old = text[a:b]
        if kind == "email":
            put = f"{new[0]}@{new[1]}"
        elif kind in ("card", "ssn", "iban"):
            put = _fill(old, new[0])
        elif kind == "phone":
            code, _, rest = new[0].partition(" ") if new[0].startswith("+") else ("", "", new[0])
            put = code + _fill(old[len(code) :], rest)
        else:
            put = new[0]
        out += [text[at:a], put]
        spans.append((a, b, kind))
        at = b
    return "".join(out) + text[at:], spans


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """kind, entity: every different entity of the corpus."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = {e for t in batch.column(0).to_pylist() if t for *_, found in find(t) for e in found}
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in seen], pa.string()) for k in (0, 1)], names=["kind", "entity"])

    return docs.select(docs[text_col].alias("text")).mapInArrow(run, "kind string, entity string").distinct()


def assign(found: DataFrame, key: bytes, rounds: int = 64) -> DataFrame:
    """kind, entity, attempt, surrogate: no two entities of a family of kinds share a surrogate, and none is an entity itself."""

    def draw(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, entity, attempt = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([surrogate(key, k, e, a) for k, e, a in zip(kind, entity, attempt, strict=True)], pa.string())], names=["kind", "entity", "attempt", "surrogate"])

    schema = "kind string, entity string, attempt int, surrogate string"
    family = F.when(F.col("kind").startswith("given"), "given").otherwise(F.col("kind"))
    given = F.col("kind").startswith("given")
    now = stage(found.withColumn("attempt", F.lit(0)).mapInArrow(draw, schema), "surrogates")
    taken = found.select(family.alias("t_family"), F.col("entity").alias("t_name")).distinct()
    for _ in range(rounds):
        shared = now.withColumn("family", family)
        # of those that share a surrogate the one with the fewest attempts, then the first, keeps it
        first = shared.groupBy("family", "surrogate").agg(F.min(F.struct("attempt", "kind", "entity")).alias("first"), F.count("*").alias("n"))
        clash = shared.join(first.where("n > 1").hint("merge"), ["family", "surrogate"]).where((F.col("first.kind") != F.col("kind")) | (F.col("first.entity") != F.col("entity"))).select("kind", "entity")
        real = shared.join(taken.hint("merge"), (F.col("family") == F.col("t_family")) & (F.col("surrogate") == F.col("t_name")), "left_semi").select("kind", "entity")
        again = stage(clash.union(real).distinct(), "collisions")
        if again.isEmpty():
            return now
        again = again.hint("merge")  # entities grow with the corpus
        redrawn = now.join(again, ["kind", "entity"], "left_semi").select("kind", "entity", (F.col("attempt") + 1).cast("int").alias("attempt")).mapInArrow(draw, schema)
        now = stage(now.join(again, ["kind", "entity"], "left_anti").select("kind", "entity", "attempt", "surrogate").union(redrawn), "surrogates")
    raise RuntimeError(f"surrogates still collide after {rounds} rounds: more different entities than the forms hold")


def pseudonymise(docs: DataFrame, key: bytes, few: int = 100_000, ids: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """ids, text (rewritten), n_replaced and spans (array<struct<start, end, kind>> in the original, code points) per row."""
    changed = stage(assign(stage(entities(docs, text_col), "entities"), key).where("attempt > 0"), "redrawn")
    picked = docs.select(*ids, docs[text_col].alias("text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields)
    schema = fields + ", n_replaced long, spans array<struct<start: long, end: long, kind: string>>"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    n = changed.count()
    shared = docs.sparkSession.sparkContext.broadcast({(r["kind"], r["entity"]): r["surrogate"] for r in changed.collect()} if n <= few else None)
    if n > few:  # each document brings the redrawn entities that it mentions
        picked = _with_redrawn(picked, changed, ids)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[tuple[str, str], str] = {}
        for batch in batches:
            own = batch.column("redrawn").to_pylist() if shared.value is None else None
            texts, spans = [], []
            for i, t in enumerate(batch.column("text").to_pylist()):
                known = shared.value if own is None else {(r["kind"], r["entity"]): r["surrogate"] for r in own[i] or ()}

                def look_up(k: str, e: str, known=known) -> str:
                    if (k, e) in known:
                        return known[k, e]
                    if (k, e) not in made:
                        if len(made) > 200_000:
                            made.clear()
                        made[k, e] = surrogate(key, k, e)
                    return made[k, e]

                new, at = replace(t, look_up) if t else (t, [])
                texts.append(new)
                spans.append([{"start": a, "end": b, "kind": k} for a, b, k in at])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(ids)], pa.array(texts, pa.string()), pa.array(map(len, spans), pa.int64()), pa.array(spans, kind)], names=[*ids, "text", "n_replaced", "spans"])

    return picked.mapInArrow(run, schema)


def _with_redrawn(picked: DataFrame, changed: DataFrame, ids: tuple[str, ...]) -> DataFrame:
    """picked with redrawn: the changed entities of each text."""

    def mentions(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(m, *e) for m, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for e in {e for *_, found in find(t) for e in found}]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))], names=["m", "kind", "entity"])

    marked = picked.withColumn("__mark", F.xxhash64("text"))
    found = marked.select("__mark", "text").mapInArrow(mentions, "m long, kind string, entity string").distinct()
    per_text = found.join(changed, ["kind", "entity"]).groupBy("m").agg(F.collect_list(F.struct("kind", "entity", "surrogate")).alias("redrawn"))
    return marked.join(per_text, F.col("__mark") == F.col("m"), "left").select(*ids, "text", "redrawn")

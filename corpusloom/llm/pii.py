"""Personal data and secrets become keyed surrogates of the same type, format, script and gender (operator 6).

An entity is a kind and a canonical value (lower case; only digits for numbers, whatever the script of the digits; of phone
numbers the last ten). Its surrogate is drawn by a keyed hash, character class by character class, and put back in the spelling of
each occurrence, so an entity has one surrogate wherever it occurs. The domain of an address is an entity of its own. Names are
mapped token by token: given names by their gender, family names on their own, each in its script. A name's gender is no part of
the entity: what most occurrences in the corpus tell holds for all of them. A title, a field "name:" or a well-known given name
before a capitalised word tells a name; the whole words of its document that repeat it, capitalised as well, are the same entity
(of several, the first). Names that nothing of the kind tells are not found.

The key is an argument, or the setting spark.corpusloom.surrogateKey of the session; the default one is public and
only good for tests.

Distinctness: over all entities of the corpus, surrogates that meet another surrogate or a real value are drawn
again until none do, itself among the real values; every eighth draw makes them longer, so that no space of surrogates is ever
used up (an address of four numbers becomes one of eight). Only entities drawn more than once, and names whose gender is told
elsewhere, are kept as a table; they reach the documents by broadcast while they are few, and by a join beyond that.

Defined cases: null texts stay null, empty ones empty; nested finds give way to the longest of the earliest;
digits of other scripts count as digits and stay in their script; repeated rows get equal results; an empty table
gives an empty table; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

import hmac
import ipaddress
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import write_table

KEY, KEY_SETTING = "corpus surrogate key", "spark.corpusloom.surrogateKey"
#: Entities drawn more than once: up to so many are broadcast (a bound of about 10 MB).
FEW = 100_000
#: Draws after which surrogates grow by one character.
GROWING = 8
#: Last digits of a phone number that tell it, with or without its country's.
NATIONAL = 10

NUMBERS = re.compile(
    r"(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d))"
    r"|(?P<card>(?<![\d.])\d{4}(?P<gap>[ -])\d{4}(?P=gap)\d{4}(?P=gap)\d{1,7}(?!\d)|(?<![\d.])\d{13,19}(?!\d))"
    r"|(?P<phone>(?<!\w)\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[-.]\d{3}[-.]\d{4}(?!\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
)
ACCOUNT = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b")
ACCESS = re.compile(r"(?i)(?<![a-z0-9])akia[0-9a-z]{16}(?![a-z0-9])")
SECRET = re.compile(r"""(?i)(?<![a-z])(?:token|secret|password|passwd|api[_-]?key)\s*[=:]\s*["']?([a-z0-9_+/=.-]{8,})""")
SECRET_WORDS = ("token", "secret", "passw", "api")
#: Addresses of eight groups, or fewer with a double colon, checked when found.
IP6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){1,7}(?::?[0-9A-Fa-f]{1,4}){1,7}(?![\w:])|(?<![\w:.])::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){1,6}(?![\w:])")
MAIL_LEFT, MAIL_RIGHT = re.compile(r"[\w%+-]+(?:\.[\w%+-]+)*\Z"), re.compile(r"(?:[a-z0-9-]+\.)+[a-z]{2,24}", re.I)
#: Titles and the gender they tell (fixed values).
TITLES = {
    "Mr.": "m", "Mr": "m", "Mister": "m", "Sir": "m", "Mrs.": "f", "Mrs": "f", "Ms.": "f", "Ms": "f", "Miss": "f", "Madam": "f", "Lady": "f", "Dr.": "", "Doctor": "", "Prof.": "", "Professor": "", "Judge": "",
    "Herr": "m", "Herrn": "m", "Frau": "f", "Señor": "m", "Sr.": "m", "Don": "m", "Señora": "f", "Sra.": "f", "Señorita": "f", "Doña": "f",
    "Monsieur": "m", "M.": "m", "Madame": "f", "Mme": "f", "Mlle": "f", "Signor": "m", "Signora": "f", "господин": "m", "госпожа": "f", "κύριος": "m", "κυρία": "f",
}
#: Given names that tell a name before a capitalised word, and their gender (fixed values).
GIVEN = {
    "m": "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Paul Steven Andrew George Kevin Brian Edward Peter Hans Klaus Jürgen Wolfgang Stefan Carlos José Juan Luis Miguel Pedro Pablo Jean Pierre Jacques Luc François Antoine Иван Пётр Сергей Дмитрий Алексей Γιώργος Νίκος Δημήτρης".split(),
    "f": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Ashley Emily Laura Jane Ada Alice Anna Ursula Monika Petra Sabine María Carmen Isabel Lucía Sofía Marie Sophie Camille Isabelle Nathalie Анна Мария Ольга Елена Наталья Μαρία Ελένη Κατερίνα".split(),
}
GENDER = {name: gender for gender, names in GIVEN.items() for name in names}
#: Capitals of the scripts that names are found in, and lower-case words inside names (fixed values).
UPPER = "".join(c for c in map(chr, [*range(0x530), *range(0x1E00, 0x2000)]) if c.isupper())
PARTICLES = ("van", "von", "de", "der", "den", "del", "della", "di", "da", "du", "la", "le", "bin", "ter")
CAPITAL = rf"(?:(?:{'|'.join(PARTICLES)})[ ])*[{UPPER}](?:['’][{UPPER}])?[^\W\d_]+"
#: Words that begin a sentence and no name (fixed values).
NO_NAMES = frozenset("And But Or If When Then He She It They We You In On At For From With As The This That There So Yes No Not".split())
NAMED = re.compile(rf"(?<!\w)(?P<title>{'|'.join(map(re.escape, sorted(TITLES, key=len, reverse=True)))})(?:[^\S\n]+(?:{'|'.join(re.escape(t) for t in TITLES if t.endswith('.'))}))*[^\S\n]+(?P<names>{CAPITAL}(?:[ -]{CAPITAL}){{0,2}})")
FIELD = re.compile(rf"(?i:(?<!\w)(?:full |my )?(?:name|nombre|nom|имя|όνομα)(?: is|:))[^\S\n]*(?P<names>{CAPITAL}(?:[ -]{CAPITAL}){{1,2}})")
KNOWN = re.compile(rf"(?<!\w)(?P<names>(?P<given>{'|'.join(GENDER)})(?:[ -]{CAPITAL}){{1,2}})")
LETTERS = re.compile(r"[^\W\d_]+")
PART = re.compile(rf"[^\W\d_](?:['’][{UPPER}])?[^\W\d_]*")
TITLE_WORDS = frozenset(t.rstrip(".") for t in TITLES)
WORD = re.compile(rf"(?<!\w){PART.pattern}(?!\w)")
#: Syllables of surrogate names and endings by gender, for each script (fixed values).
SCRIPTS = {
    "latin": ("ba be da de fa ga ka ke la le li lo ma me mi na ne ni no pa ra re ri ro sa se si ta te ti to va ve vi za".split(), {"m": ["n", "s", "rd"], "f": ["na", "lia", "ra"], "": ["ner", "man", "ley"]}),
    "cyrillic": ("ба бе да де га ка ла ле ли ма ме ми на не ни па ра ре ри са се си та те ти ва ве ви за".split(), {"m": ["н", "р", "с"], "f": ["на", "ла", "ра"], "": ["нко", "вич", "дзе"]}),
    "greek": ("βα βε γα δα δε κα λα λε λι μα με μι να νε νι πα ρα ρε ρι σα σε τα τε τι".split(), {"m": ["ος", "ης", "ας"], "f": ["να", "λη", "ρα"], "": ["ιδης", "ακης", "ουλου"]}),
}


def luhn(digits: str) -> bool:
    return not sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10


def mod97(account: str) -> int:
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


OTHER_DIGIT = re.compile(r"(?![0-9])\d")


def plain_digits(text: str) -> str:
    """Digits of other scripts as 0 to 9, in their places."""
    return text if text.isascii() else OTHER_DIGIT.sub(lambda m: str(unicodedata.decimal(m[0])), text)


def digits_of(value: str) -> str:
    return "".join(c for c in value if c in "0123456789")


def lower(value: str) -> str:
    """Lower case, character by character, so that places stay."""
    return "".join(x if len(x := c.lower()) == 1 else c for c in value)


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical value) of every entity, in order, without overlaps."""
    found, written = [], text
    text = plain_digits(text)
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin and (text[begin - 1].isalnum() or text[begin - 1] in "_%+-."):
            begin -= 1
        left, right = MAIL_LEFT.search(text[begin:at]), MAIL_RIGHT.match(text, at + 1)
        if left and right:
            found.append((at - len(left[0]), at, "email", lower(left[0] + "@" + right[0])))
            found.append((at + 1, right.end(), "domain", lower(right[0])))
        at = text.find("@", at + 1)
    if re.search(r"\d", text):
        for m in NUMBERS.finditer(text):
            kind, digits = m.lastgroup if m.lastgroup != "gap" else "card", digits_of(m[0])
            if kind != "card" or luhn(digits):
                found.append((m.start(), m.end(), kind, m[0] if kind == "ip" else digits[-NATIONAL:] if kind == "phone" else digits))
        for m in ACCOUNT.finditer(text):
            if mod97(value := m[0].replace(" ", "")) == 1:
                found.append((m.start(), m.end(), "iban", lower(value)))
        found += [(m.start(), m.end(), "access", lower(m[0])) for m in ACCESS.finditer(text)]
    if text.count(":") > 2:
        found += [(m.start(), m.end(), "ip6", value) for m in IP6.finditer(text) if (value := address(m[0]))]
    small = text.lower()
    if any(w in small for w in SECRET_WORDS):
        found += [(m.start(1), m.end(1), "secret", lower(m[1])) for m in SECRET.finditer(text) if re.search(r"\d", m[1])]
    found += names_in(text)
    out, end = [], -1
    for x in sorted(found, key=lambda x: (x[0], -x[1], x[2])):
        if x[0] >= end:
            out.append(x)
            end = x[1]
    return repeats(written, out)


def names_in(text: str) -> list[tuple[int, int, str, str]]:
    """The tokens of names: after titles, in fields, and after well-known given names."""
    held, out = set(LETTERS.findall(text)), []
    runs = [(m, TITLES[m["title"]]) for m in NAMED.finditer(text)] if not TITLE_WORDS.isdisjoint(held) else []
    if any(x in text for x in ("ame:", "ame is", "ombre:", "om:", "мя:", "νομα:")):
        runs += [(m, None) for m in FIELD.finditer(text)]
    if not GENDER.keys().isdisjoint(held):
        runs += [(m, GENDER[m["given"]]) for m in KNOWN.finditer(text)]
    for m, gender in runs:
        parts, begin = [x for x in PART.finditer(m["names"]) if x[0] not in PARTICLES], m.start("names")
        if parts[0][0] in NO_NAMES:
            continue
        for k, part in enumerate(parts):
            known = GENDER.get(part[0], "") if not gender else gender
            out.append((begin + part.start(), begin + part.end(), "family" if k == len(parts) - 1 else f"given-{known}", lower(part[0])))
    return out


def address(text: str) -> str | None:
    """An address of eight groups in full, if it is one that names a host or net by three groups or more."""
    try:
        found = ipaddress.IPv6Address(text)
    except ValueError:
        return None
    return found.exploded if len(re.findall("[0-9A-Fa-f]+", text)) > 2 else None


def is_name(kind: str) -> bool:
    return kind == "family" or kind.startswith("given")


def repeats(text: str, found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """The entities and, outside them, the words that repeat a found name as it is spelled or capitalised as well."""
    exact, names = {}, {}
    for start, end, kind, value in found:
        if is_name(kind):
            exact.setdefault(text[start:end], (kind, value))
            if not text[start].islower():
                names.setdefault(value, (kind, value))
    if not exact:
        return found
    more, k = [], 0
    for m in WORD.finditer(text):
        while k < len(found) and found[k][1] <= m.start():
            k += 1
        if k < len(found) and found[k][0] < m.end():
            continue
        entity = exact.get(m[0]) if m[0][0].islower() else names.get(lower(m[0])) or exact.get(m[0])
        if entity:
            more.append((m.start(), m.end(), *entity))
    return sorted(found + more)


def stream(key: bytes, kind: str, value: str, draw: int) -> Iterator[int]:
    """Keyed bytes without end."""
    block = 0
    while True:
        yield from hmac.digest(key, f"{kind}\0{value}\0{draw}\0{block}".encode(), "sha256")
        block += 1


def number(bits: Iterator[int], below: int) -> int:
    return int.from_bytes(bytes(next(bits) for _ in range(6))) % below


def like(value: str, bits: Iterator[int], longer: int = 0) -> str:
    """Each digit by a digit, each letter by a letter; hexadecimal values stay so. The last class goes on for so many more."""
    letters = "abcdef" if re.fullmatch("[0-9a-f]+", value) else "abcdefghijklmnopqrstuvwxyz"
    last = next((c for c in reversed(value) if c.isalnum()), "a")
    return "".join(str(number(bits, 10)) if c in "0123456789" else letters[number(bits, len(letters))] if c.isalpha() else c for c in value + last * longer)


def script_of(value: str) -> str:
    return "cyrillic" if re.search("[Ѐ-ӿ]", value) else "greek" if re.search("[Ͱ-Ͽ]", value) else "latin"


def surrogate(kind: str, value: str, draw: int, key: bytes) -> str:
    """The canonical surrogate of an entity at this draw."""
    bits, longer = stream(key, kind, value, draw), draw // GROWING
    if kind == "email":
        local, _, domain = value.partition("@")
        return f"{like(local, bits, longer)}@{domain}"  # the domain is an entity of its own
    if kind == "domain":
        name, dot, top = value.rpartition(".")
        return f"{like(name, bits, longer)}{dot}{top}"
    if kind == "ip6":
        return ":".join(f"{number(bits, 65_536):04x}" for _ in range(8 + longer))
    if kind == "ip":
        if longer:
            return ":".join(f"{number(bits, 65_536):x}" for _ in range(8))
        return ".".join(str(1 + number(bits, 254)) for _ in range(4))
    if kind == "card":
        body = value[0] + like(value[1:-1], bits, longer)
        return next(body + d for d in "0123456789" if luhn(body + d))
    if kind == "phone":
        return value[:1] + like(value[1:], bits, longer)
    if kind == "iban":
        body = like(value[4:], bits, longer)
        return f"{value[:2]}{98 - mod97(value[:2] + '00' + body):02d}{body}"
    if kind == "access":
        return value[:4] + like(value[4:], bits, longer)
    if is_name(kind):
        syllables, endings = SCRIPTS[script_of(value)]
        ends = endings[kind.partition("-")[2]]
        return "".join(syllables[number(bits, len(syllables))] for _ in range(3 + draw // 4)) + ends[number(bits, len(ends))]
    return like(value, bits, longer)


def written(original: str, new: str) -> str:
    """A character in the case, or with the script's digits, of the one it stands for."""
    if new in "0123456789" and original.isdecimal() and not original.isascii():
        return chr(ord(original) - unicodedata.decimal(original) + int(new))
    return new.upper() if original.isupper() else new


def spelled(original: str, value: str, kind: str) -> str:
    """The surrogate in the spelling of an occurrence: its punctuation, case and digits."""
    if kind in ("card", "phone", "ssn", "iban"):
        new, out = iter(value), []
        stays = max(0, sum(c.isalnum() for c in original) - NATIONAL) if kind == "phone" else 0  # the country's digits
        for c in original:
            out.append(c if not c.isalnum() or (stays := stays - 1) >= 0 else written(c, next(new, "")))
        return "".join(out) + "".join(written(original[-1], x) for x in new)
    if is_name(kind):
        return value.upper() if original.isupper() and len(original) > 1 else value.capitalize()
    if kind == "email":
        value = value.partition("@")[0]
    if len(value) < len(original) or kind in ("ip", "ip6"):
        return value
    if kind == "domain":  # what has grown stands before the last part
        name, dot, top = original.rpartition(".")
        return spelled(name, value.rpartition(".")[0], "") + dot + top
    last = next((c for c in reversed(original) if c.isalnum()), "a")
    return "".join(written(c, x) for c, x in zip(original + last * (len(value) - len(original)), value, strict=True))


@lru_cache(20_000)
def first_draw(kind: str, value: str, key: bytes) -> str:
    return surrogate(kind, value, 0, key)


def replaced(text: str, of: Callable[[str, str], str]) -> tuple[str, list[str]]:
    parts, kinds, end = [], [], 0
    for start, stop, kind, value in find(text):
        parts += [text[end:start], spelled(text[start:stop], of(kind, value), kind)]
        kinds.append(kind)
        end = stop
    return "".join(parts) + text[end:], kinds


ENTITY = pa.schema([("told", pa.string()), ("value", pa.string()), ("n", pa.int64())])


def entities(docs: DataFrame) -> DataFrame:
    """kind, value, told (the kind as each occurrence tells it) over all documents: the gender of a given name is the one that most
    occurrences tell, the lesser of several; one that nothing tells gives way to any."""

    def run(batches):
        for batch in batches:
            found = Counter(x[2:] for t in batch.column("text").to_pylist() if t for x in find(t))
            yield pa.RecordBatch.from_pydict({"told": [x[0] for x in found], "value": [x[1] for x in found], "n": list(found.values())}, ENTITY)

    counted = docs.select("text").mapInArrow(run, "told string, value string, n long").groupBy("told", "value").agg(F.sum("n").alias("n"))
    base = F.split_part("told", F.lit("-"), F.lit(1))
    given = counted.withColumn("base", base)
    rank = F.struct((F.col("told") != "given-").alias("sure"), "n", F.when(F.col("told") == "given-f", 1).otherwise(0).alias("f"))
    best = given.groupBy("base", "value").agg(F.max_by("told", rank).alias("kind"), F.collect_set("told").alias("told"))
    return best.select("kind", "value", F.explode("told").alias("told"))


def redrawn(known: DataFrame, key: bytes) -> DataFrame:
    """kind, value, surrogate of the entities whose first draw meets a real value or another's surrogate."""

    def drawn(batches):
        for batch in batches:
            rows = batch.to_pylist()
            made = [surrogate(r["kind"], r["value"], r["draw"], key) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("value"), batch.column("draw"), pa.array(made, pa.string())], names=["kind", "value", "draw", "surrogate"])

    schema = "kind string, value string, draw int, surrogate string"
    open_, settled = known.withColumn("draw", F.lit(0)), None
    later = None
    while True:  # spaces grow with the draws, so rounds end
        rows = write_table(open_.mapInArrow(drawn, schema), "drawn")
        # the least value keeps a surrogate that several drew; real values and settled surrogates are taken
        first = rows.groupBy("kind", "surrogate").agg(F.min("value").alias("value"))
        taken = known.select("kind", F.col("value").alias("surrogate"))
        if settled is not None:
            taken = taken.unionByName(settled.select("kind", "surrogate"))
        good = first.join(taken, ["kind", "surrogate"], "left_anti").select("kind", "value")
        fine = rows.join(good, ["kind", "value"], "left_semi")
        rest = write_table(rows.join(good, ["kind", "value"], "left_anti"), "redrawn")
        settled = fine if settled is None else settled.unionByName(fine)
        later = fine.where("draw > 0") if later is None else later.unionByName(fine.where("draw > 0"))
        if rest.isEmpty():
            return later.select("kind", "value", "surrogate")
        open_ = rest.select("kind", "value", (F.col("draw") + 1).alias("draw"))


def with_surrogates(docs: DataFrame, key: str | None = None, kinds: str | None = None) -> DataFrame:
    """The rows with surrogates in text; kinds: a further column (array) with the kind of each entity, in order."""
    spark = docs.sparkSession
    secret = (key or spark.conf.get(KEY_SETTING, KEY)).encode()
    found = write_table(entities(docs), "entities")
    again = write_table(with_genders(redrawn(found.select("kind", "value").distinct(), secret), found, secret), "exceptions")
    few = again.limit(FEW + 1).count() <= FEW
    known = spark.sparkContext.broadcast({(r.kind, r.value): r.surrogate for r in again.collect()} if few else {})
    rows = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))
    if few:
        rows = rows.withColumn("again", F.expr("cast(null as array<struct<kind: string, value: string, surrogate: string>>)"))
    else:
        rows = with_exceptions(rows, again)
    rows = rows.withColumn("row", F.col("row").withField("text", F.lit(None).cast("string"))).select("row", "text", "again")
    schema = rows.drop("again").withColumn("kinds", F.expr("cast(array() as array<string>)")).schema

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                made, found = [], []
                for text, own in zip(part.column("text").to_pylist(), part.column("again").to_pylist(), strict=True):
                    special = {(x["kind"], x["value"]): x["surrogate"] for x in own} if own else known.value
                    new, of = (None, []) if text is None else replaced(text, lambda kind, value, s=special: s.get((kind, value)) or first_draw(kind, value, secret))
                    made.append(new)
                    found.append(of)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(made, pa.string()), pa.array(found, pa.list_(pa.string()))], names=["row", "text", "kinds"])

    columns = [F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]
    return rows.mapInArrow(run, schema).select(*columns, *([] if kinds is None else [F.col("kinds").alias(kinds)]))


def with_genders(again: DataFrame, found: DataFrame, key: bytes) -> DataFrame:
    """The exceptions, also under the kinds that single occurrences tell, and names whose gender is told elsewhere."""

    @F.pandas_udf("string")
    def drawn(kinds: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([surrogate(k, v, 0, key) for k, v in zip(kinds, values, strict=True)], dtype=object)

    other = found.where("told != kind").join(again, ["kind", "value"], "left")
    return again.unionByName(other.select(F.col("told").alias("kind"), "value", F.coalesce("surrogate", drawn("kind", "value")).alias("surrogate")))


def with_exceptions(rows: DataFrame, again: DataFrame) -> DataFrame:
    """Adds again to (row, text): the exceptions that a text holds. Texts are keyed by their digest, so equal ones meet once."""

    def run(batches):
        for batch in batches:
            found = [(k, *x[2:]) for k, t in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True) if t for x in find(t)]
            yield pa.RecordBatch.from_pydict({"key": pa.array([x[0] for x in found], pa.string()), "kind": pa.array([x[1] for x in found], pa.string()), "value": pa.array([x[2] for x in found], pa.string())})

    keyed = rows.withColumn("key", F.sha2(F.col("text").cast("binary"), 256))
    held = keyed.select("key", "text").mapInArrow(run, "key string, kind string, value string").distinct()
    own = held.join(again, ["kind", "value"]).groupBy("key").agg(F.collect_list(F.struct("kind", "value", "surrogate")).alias("again"))
    return keyed.join(own, "key", "left").drop("key")

r"""Surrogates for personal data, with DataFrame functions only.

One pattern finds e-mail and IP addresses, phone, card, social-security and account (IBAN) numbers, secrets (keys,
tokens, passwords) and persons: capitalised names after an honorific or a known given name, and, unless they hold a word
that stands in places and organisations, after words that introduce a name ("my name is", "Dear", "regards,", "signed",
"wrote to" and the like) or before a verb of saying, whatever the name. Each entity has a canonical form (digits of a
number, lower case of an address), and its surrogate comes from the HMAC-SHA-512 of type, canonical form and attempt:
digits become digits, letters letters of the same case, separators stay; the leading digit of a +number and of a card
stays, a valid Luhn sum stays valid. Equal entities therefore get equal surrogates everywhere (coreference) however
they are written: ten digits with or without +1 or 1 before them are one phone number, and 00 before a number is +.

The given names and the surname of a person are entities of their own, so "Mr. John Smith", "Mrs. Smith" and "Dr. Smith"
share one new surname. A given name keeps its script and its gender: that of the fixed list, else the one that most
titles before it have in the corpus. One word after a title is a surname unless it is a known given name.

The key is an argument; where it is not given, the session's spark.panelloom.pii.key, and without that a random key, so that
nobody can look numbers up (surrogates of two runs then differ).

Collision check: over all distinct entities no surrogate may stand for two, or equal an entity of the corpus; the
losers get the next attempt until none is left. Texts are searched once; only occurrences travel for the check, and
each text is shuffled once to meet its surrogates. The most common entities, a bounded table, are met by broadcast.

Edge cases: null and empty texts stay as they are; repeated rows get equal results; rows of one id, or of none, are told
apart by their texts; where a format's space is used up the losers' surrogates are widened after `max_attempts` by
letters or digits (so they no longer fit the format), and an error tells how many are left if that does not end; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm._spark import checkpointed, met_unevenly, read

#: Honorifics and given names that mark persons, by gender and script.
HONORIFICS = {"m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Г-н"], "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Г-жа"], "n": ["Dr", "Prof"]}
GIVEN = {
    ("m", "latin"): ["James", "John", "Robert", "Michael", "William", "David", "Thomas", "Peter", "Hans", "Jean", "Pierre", "Carlos", "Antonio", "Miguel", "Paul", "Daniel"],
    ("f", "latin"): ["Mary", "Anna", "Linda", "Susan", "Karen", "Laura", "Emma", "Julia", "Sophie", "Claire", "Elena", "Lucia", "Carmen", "Helen", "Alice", "Sarah"],
    ("m", "cyrillic"): ["Иван", "Алексей", "Сергей", "Дмитрий", "Николай", "Павел", "Михаил", "Андрей"],
    ("f", "cyrillic"): ["Анна", "Мария", "Ольга", "Елена", "Наталья", "Ирина", "Татьяна", "Светлана"],
}
_ONSET = {"latin": ["b", "d", "f", "g", "k", "l", "m", "n", "p", "r", "s", "t", "v", "w", "h", "z"], "cyrillic": ["б", "д", "ф", "г", "к", "л", "м", "н", "п", "р", "с", "т", "в", "ж", "х", "з"]}
_RIME = {"latin": ["an", "el", "in", "or", "ar", "en", "il", "on"], "cyrillic": ["ан", "ел", "ин", "ор", "ар", "ен", "ил", "он"]}

#: Verbs of saying that follow a name.
_SAYING = ["said", "says", "wrote", "writes", "told", "asked", "replied", "answered", "added", "explained"]
#: Capitalised words that are no part of a person's name after a cue or before a verb of saying.
_NO_NAME = [
    "The", "This", "That", "These", "Those", "He", "She", "They", "We", "You", "It", "Who", "But", "And", "Or", "If", "In", "On", "At", "As", "For", "From", "To", "When", "Then", "There", "Here", "What",
    "Sir", "Madam", "All", "Everyone", "Customer", "Customers", "Service", "Services", "Support", "Sales", "Team", "Friend", "Friends", "Reader", "Readers", "Editor", "Manager", "Hiring", "Human", "Resources",
    "New", "Los", "Las", "San", "Santa", "Saint", "Fort", "North", "South", "East", "West", "United", "States", "Kingdom", "City", "County", "River", "Lake", "Street", "Road", "Avenue",
    "General", "White", "House", "Company", "Bank", "University", "College", "School", "Ministry", "Department", "Court", "Supreme", "Group", "Council", "Committee", "Commission", "Police", "Party", "Union", "Institute", "Office", "Agency", "Times", "News", "Press", "License", "Public", "Foundation", "National", "International",
    "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday", "January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December",
]

_HONORIFIC = "(?:" + "|".join(x for names in HONORIFICS.values() for x in names) + r")\.?"
_KNOWN = "(?:" + "|".join(x for names in GIVEN.values() for x in names) + ")"
_NAME = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?"
#: Words right before a name of two or three capitalised words, in any letter case.
_CUES = ["name is", "named", "wrote to", "spoke to", "dear", "regards,", "sincerely,", "signed", "signed by", "contact", "contact:", "author:", "from:", "to:", "attn:", "name:"]
_CUE = "(?i:" + "|".join(rf"(?<=\b{x} )" for x in _CUES) + ")"
_OWN = rf"(?!(?:{'|'.join(_NO_NAME)})(?!\p{{L}})){_NAME}"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}",
    "secret": r"(?<!\w)AKIA[0-9A-Z]{12,20}(?!\w)|(?<!\w)(?i:password|passwd|secret|token|api_key)\s{0,3}[=:]\s{0,3}\"?[^\s\"]{6,}+\"?",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w.+])(?!00)\d(?:[ -]?\d){12,18}(?!\w)",
    "phone": r"(?<![\w+])(?:(?:\+|00)\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?!\w)|(?<![\w+])\+\d{7,15}(?!\w)",
    "person": rf"(?<!\p{{L}}){_HONORIFIC} {_NAME}(?: {_NAME})?|(?<!\p{{L}}){_KNOWN} {_NAME}|{_CUE}{_OWN}(?: {_OWN}){{1,2}}|(?<!\p{{L}}){_OWN} {_OWN}(?= (?:{'|'.join(_SAYING)})(?!\p{{L}}))",
}
#: First characters that each kind can begin with; the pattern looks at a kind only where a word begins with one.
_BEGINS = {"secret": "[AaPpSsTt]", "ip": "[0-9]", "iban": "[A-Z]", "ssn": "[0-9]", "card": "[0-9]", "phone": "[0-9+(]", "person": r"\p{Lu}", "email": "[A-Za-z0-9._%+-]"}


def _guarded(kinds: list[str]) -> str:
    by_first: dict[str, list[str]] = {}
    for kind in kinds:
        by_first.setdefault(_BEGINS[kind], []).append(PATTERNS[kind])
    return r"(?<![A-Za-z0-9_])(?:" + "|".join(f"(?={first})(?:{'|'.join(f'(?:{p})' for p in own)})" for first, own in by_first.items()) + ")"


PATTERN = _guarded(list(PATTERNS))
#: The same for texts without an at sign.
PATTERN_NO_EMAIL = _guarded([k for k in PATTERNS if k != "email"])


def _digest(key: str, kind: F.Column, canonical: F.Column, attempt: F.Column) -> F.Column:
    """HMAC-SHA-512 in hexadecimal digits."""
    own = key.encode()
    block = (hashlib.sha512(own).digest() if len(own) > 128 else own).ljust(128, b"\0")
    inner, outer = (F.lit(bytearray(x ^ pad for x in block)) for pad in (0x36, 0x5C))
    message = F.concat_ws("\x1f", kind, attempt.cast("string"), canonical).cast("binary")
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 512))), 512)


def _byte(digest: F.Column, i: F.Column) -> F.Column:
    """Byte i (counted from 0, around) of a hexadecimal digest."""
    return F.conv(F.substr(digest, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _reshape(text: F.Column, digest: F.Column, keep: F.Column, letters: int | F.Column = 26) -> F.Column:
    """Digits to digits and ASCII letters to the first `letters` letters of their case, from place `keep` (0-based) on."""

    def one(i: F.Column) -> F.Column:
        c, b = F.substr(text, i + 1, F.lit(1)), _byte(digest, i)
        new = F.when(c.between("0", "9"), (b % 10).cast("string")).when(c.between("a", "z"), F.char(97 + b % letters)).when(c.between("A", "Z"), F.char(65 + b % letters)).otherwise(c)
        return F.when(i < keep, c).otherwise(new)

    return F.when(F.length(text) == 0, text).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.length(text) - 1), one), ""))


def _luhn(digits: F.Column) -> F.Column:
    """The Luhn sum of a digit string, modulo 10."""

    def add(total: F.Column, i: F.Column) -> F.Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10


#: The session's setting of the key.
KEY_SETTING = "spark.panelloom.pii.key"
#: The kinds that a person is made of.
NAMES = ("given", "surname")


def entity_type(surface: F.Column) -> F.Column:
    out = F.lit("person")
    for kind in reversed([k for k in PATTERNS if k != "person"]):
        out = F.when(F.rlike(surface, F.lit(f"^(?:{PATTERNS[kind]})$")), kind).otherwise(out)
    return out


def canonical_form(kind: F.Column, surface: F.Column) -> F.Column:
    """What equal entities share; of a name its word, which named_canonical completes."""
    return (
        F.when(kind == "email", F.lower(surface))
        .when(kind == "phone", F.regexp_replace(F.regexp_replace(F.regexp_replace(surface, "[^0-9+]", ""), "^00", "+"), r"^\+?1(?=\d{10}$)", ""))
        .when(kind.isin("card", "ssn"), F.regexp_replace(surface, "[^0-9]", ""))
        .when(kind == "iban", F.regexp_replace(surface, " ", ""))
        .when(kind.isin(*NAMES), F.regexp_replace(surface, f"^{_HONORIFIC} ", ""))
        .otherwise(surface)
    )


def name_parts(kind: F.Column, surface: F.Column) -> F.Column:
    """Array of (kind, surface, title gender): a person's words, the title with the first of them; any other entity whole."""
    words = F.split(F.regexp_replace(surface, f"^({_HONORIFIC}) ", "$1\x1f"), " ")
    last = F.size(words) - 1

    def part(word: F.Column, i: F.Column) -> F.Column:
        known = F.rlike(word, F.lit(f"(?:^|\x1f){_KNOWN}$"))
        own = F.when((i < last) | ((last == 0) & known), "given").otherwise("surname")
        return F.struct(own.alias("kind"), F.replace(word, F.lit("\x1f"), F.lit(" ")).alias("surface"), _gender(surface).alias("gender"))

    whole = F.array(F.struct(kind.alias("kind"), surface.alias("surface"), F.lit("n").alias("gender")))
    return F.when(kind == "person", F.transform(words, part)).otherwise(whole)


def named_canonical(kind: F.Column, form: F.Column, gender: F.Column) -> F.Column:
    """gender/script/word of a name, where a known given name's own gender comes first; the form of any other entity."""
    own = _gender(form)
    script = F.when(F.rlike(form, F.lit(r"\p{IsCyrillic}")), "cyrillic").otherwise("latin")
    return F.when(kind == "given", F.concat_ws("/", F.when(own != "n", own).otherwise(gender), script, form)).when(kind == "surname", F.concat_ws("/", F.lit("n"), script, form)).otherwise(form)


def _gender(surface: F.Column) -> F.Column:
    out = F.lit("n")
    for g in ("m", "f"):
        given = [x for (sex, _), names in GIVEN.items() if sex == g for x in names]
        out = F.when(F.rlike(surface, F.lit(rf"^(?:(?:{'|'.join(HONORIFICS[g])})\.? )|^(?:{_HONORIFIC} )?(?:{'|'.join(given)})(?: |$)")), g).otherwise(out)
    return out


def _pick(names: list[str], b: F.Column) -> F.Column:
    return F.get(F.array(*[F.lit(x) for x in names]), b % len(names))


def _syllable(script: str, digest: F.Column):
    return lambda i: F.concat(_pick(_ONSET[script], _byte(digest, i * 2)), _pick(_RIME[script], _byte(digest, i * 2 + 1)))


def with_surrogate(entities: DataFrame, key: str) -> DataFrame:
    """Adds surrogate to (kind, canonical, attempt); the digest is a column of its own, so it is computed once a row."""
    kind, canonical, attempt = F.col("kind"), F.col("canonical"), F.col("attempt")
    return entities.withColumn("digest", _digest(key, kind, canonical, attempt)).withColumn("surrogate", surrogate_form(kind, canonical, attempt, F.col("digest"))).drop("digest")


def surrogate_form(kind: F.Column, canonical: F.Column, attempt: F.Column, digest: F.Column) -> F.Column:
    """The canonical form of the surrogate."""
    last_dot = F.length(canonical) - F.length(F.substring_index(canonical, ".", -1))
    address = F.concat(_reshape(F.substr(canonical, F.lit(1), last_dot), digest, F.lit(0)), F.substr(canonical, last_dot + 1, F.length(canonical)))
    longer = F.when(attempt > 0, F.concat(F.char(97 + attempt % 26), address)).otherwise(address)
    kept = F.length(F.regexp_extract(canonical, r"^(?:AKIA|[^=:]*[=:]\s*\"?)", 0))
    number = _reshape(canonical, digest, F.when(kind == "card", 1).when(F.startswith(canonical, F.lit("+")), 2).otherwise(0))
    open_card = F.concat(F.substr(number, F.lit(1), F.length(number) - 1), F.lit("0"))
    card = F.when(_luhn(canonical) == 0, F.concat(F.substr(number, F.lit(1), F.length(number) - 1), ((10 - _luhn(open_card)) % 10).cast("string"))).otherwise(number)
    ip = F.concat_ws(".", *[(_byte(digest, F.lit(k)) % 254 + 1).cast("string") for k in range(4)])
    parts = F.split(canonical, "/", 3)
    gender, script = F.get(parts, 0), F.get(parts, 1)
    name = F.lit("")
    for s in ("latin", "cyrillic"):
        given = F.when(gender == "m", _pick(GIVEN["m", s], _byte(digest, F.lit(0)))).when(gender == "f", _pick(GIVEN["f", s], _byte(digest, F.lit(0)))).otherwise(_pick(GIVEN["m", s] + GIVEN["f", s], _byte(digest, F.lit(0))))
        made = lambda n: F.initcap(F.array_join(F.transform(F.sequence(F.lit(1), n), _syllable(s, digest)), ""))  # noqa: B023, E731
        # The known names are few: a later attempt makes a name, with the ending of its gender.
        ending = F.when(gender == "f", F.lit("a" if s == "latin" else "а")).otherwise("")
        own = F.when(kind == "surname", made(attempt + 3)).when(attempt == 0, given).otherwise(F.concat(made(attempt + 1), ending))
        name = F.when(script == s, own).otherwise(name)
    name = F.concat_ws("/", gender, script, name)
    return (
        F.when(kind == "email", longer)
        .when(kind == "ip", ip)
        .when(kind == "card", card)
        .when(kind.isin("phone", "ssn"), number)
        .when(kind == "iban", _reshape(canonical, digest, F.lit(2)))
        .when(kind == "secret", _reshape(canonical, digest, kept, F.when(F.rlike(F.substr(canonical, kept + 1, F.length(canonical)), F.lit('^[0-9a-f]+"?$')), 6).otherwise(26)))
        .otherwise(name)
    )


def in_surface(kind: F.Column, surface: F.Column, canonical: F.Column, surrogate: F.Column) -> F.Column:
    """The surrogate written as the entity was: the separators and prefix of a number, the honorific of a person, capitals."""
    signs = F.when(kind == "iban", F.lit("[^A-Za-z0-9]")).otherwise(F.lit("[^0-9]"))
    bare = lambda c: F.regexp_replace(c, signs, F.lit(""))
    # A number may be written with a prefix that its canonical form lacks; that stays.
    prefix = F.greatest(F.length(bare(surface)) - F.length(bare(canonical)), F.lit(0))

    def place(i: F.Column) -> F.Column:
        before = F.length(bare(F.substr(surface, F.lit(1), i + 1))) - prefix
        c = F.substr(surface, i + 1, F.lit(1))
        return F.when((bare(c) == "") | (before < 1), c).otherwise(F.substr(bare(surrogate), before, F.lit(1)))

    spread = F.array_join(F.transform(F.sequence(F.lit(0), F.length(surface) - 1), place), "")
    spread = F.concat(spread, F.substr(bare(surrogate), F.length(bare(surface)) - prefix + 1, F.length(surrogate)))
    title = F.regexp_extract(surface, f"^(?:{_HONORIFIC} )?", 0)
    name = F.concat(title, F.get(F.split(surrogate, "/", 3), 2))
    email = F.when(surface == F.upper(surface), F.upper(surrogate)).otherwise(surrogate)
    return F.when(kind.isin("phone", "card", "ssn", "iban"), spread).when(kind.isin(*NAMES), name).when(kind == "email", email).otherwise(surrogate)


def _widened(kind: F.Column, surrogate: F.Column, canonical: F.Column, attempt: F.Column, max_attempts: int, key: str) -> F.Column:
    """From `max_attempts` on, kinds of a fixed width get ever more digits of a digest: one at first, up to 16."""
    over = attempt - max_attempts + 1
    count = F.least(over, F.lit(16))
    digest = _digest(key + ":wider", kind, canonical, attempt)
    more = F.array_join(F.transform(F.sequence(F.lit(0), count - 1), lambda i: (_byte(digest, i) % 10).cast("string")), "")
    return F.when((over > 0) & ~kind.isin("email", *NAMES), F.concat(surrogate, F.when(kind == "ip", F.lit(".")).otherwise(F.lit("")), more)).otherwise(surrogate)


def assign_surrogates(entities: DataFrame, key: str, max_attempts: int = 12) -> DataFrame:
    """(kind, canonical, surrogate) for distinct (kind, canonical), free of collisions; a name's word is what must differ.

    After max_attempts the surrogates of losers are widened, so that attempts go on until none is left; if 64 of those
    are not enough, the number of losers is raised as an error.
    """
    known = checkpointed(entities.select("kind", "canonical").distinct())

    def named(state: DataFrame) -> DataFrame:
        # A surrogate takes about a millisecond, so tasks are cut by entities, not by their few bytes. The rows are written
        # in that many parts: a filter on the surrogate would be moved to the other side of an exchange alone.
        tasks = max(1, min(state.count() // 1000, 100_000))
        out = with_surrogate(checkpointed(state.repartition(tasks, "kind", "canonical")), key)
        return checkpointed(out.withColumn("surrogate", _widened(F.col("kind"), F.col("surrogate"), F.col("canonical"), F.col("attempt"), max_attempts, key)))

    def shown(column: str) -> list:
        kind = F.col("kind")
        return [F.when(kind.isin(*NAMES), "name").otherwise(kind).alias("family"), F.when(kind.isin(*NAMES), F.substring_index(column, "/", -1)).otherwise(F.col(column)).alias("shown")]

    real = known.select(*shown("canonical")).distinct().withColumn("is_real", F.lit(True))
    state = named(known.withColumn("attempt", F.lit(0)))
    for _ in range(max_attempts + 64):
        seen = state.select("*", *shown("surrogate"))
        winner = seen.groupBy("family", "shown").agg(F.min(F.struct("attempt", "kind", "canonical")).alias("w"))
        judged = seen.join(winner, ["family", "shown"]).join(real, ["family", "shown"], "left")
        lost = F.coalesce("is_real", F.lit(False)) | (F.col("canonical") != F.col("w.canonical")) | (F.col("kind") != F.col("w.kind"))
        state = checkpointed(judged.select("kind", "canonical", "attempt", "surrogate", lost.alias("lost")))
        losers = state.where("lost").select("kind", "canonical", F.col("attempt") + 1)
        if losers.isEmpty():
            return state.select("kind", "canonical", "surrogate")
        # A winner keeps its surrogate: later attempts of others lose against it.
        again = named(losers.toDF("kind", "canonical", "attempt"))
        state = state.where("not lost").drop("lost").unionByName(again.select("kind", "canonical", "attempt", "surrogate"))
    raise RuntimeError(f"{losers.count()} entities have no surrogate of their own")


def replace_entities(docs: DataFrame, key: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_entities, text) of every row with surrogates in place of entities."""
    key = key or docs.sparkSession.conf.get(KEY_SETTING, None) or secrets.token_hex(32)
    own = F.col(id_column).cast("long")
    texts = docs.select(F.coalesce(own, F.lit(0)).alias("doc"), F.xxhash64(text_column).alias("text_key"), own.alias("doc_id"), F.col(text_column).alias("text"))
    found = F.when(F.instr("text", "@") > 0, F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))).otherwise(F.regexp_extract_all("text", F.lit(PATTERN_NO_EMAIL), F.lit(0)))
    spread = texts.select("doc", "text_key", F.posexplode(found).alias("place", "surface"))
    kind, surface = F.col("kind"), F.col("surface")
    parts = spread.withColumn("kind", entity_type(surface)).select("doc", "text_key", "place", F.posexplode(name_parts(kind, surface)).alias("part", "own"))
    seen = checkpointed(parts.select("doc", "text_key", "place", "part", "own.*").withColumn("canonical", canonical_form(kind, surface)))
    men, women = F.count_if(F.col("gender") == "m"), F.count_if(F.col("gender") == "f")
    gender = F.when(men > women, "m").when(women > men, "f").otherwise("n")
    forms = seen.groupBy("kind", F.col("canonical").alias("form")).agg(F.count(F.lit(1)).alias("n"), gender.alias("gender"))
    counts = checkpointed(forms.select("kind", "form", "n", named_canonical(kind, F.col("form"), F.col("gender")).alias("canonical")))
    table = checkpointed(assign_surrogates(counts, key).join(counts, ["kind", "canonical"]).select("kind", F.col("form").alias("canonical"), "n", "surrogate"))
    met = met_unevenly(seen.withColumn("form", F.col("canonical")), table, ["canonical", "kind"], "surrogate", ["doc", "text_key", "place"])
    written = met.select("doc", "text_key", F.struct("place", "part", in_surface(kind, surface, F.col("form"), F.col("surrogate")).alias("s")).alias("p"))
    # Rows equal in id and text have their entities as often as there are rows; a set holds them once.
    by_text = written.groupBy("doc", "text_key").agg(F.sort_array(F.collect_set("p")).alias("p"))
    pieces = F.split("text", F.when(F.instr("text", "@") > 0, PATTERN).otherwise(PATTERN_NO_EMAIL), -1)
    joined = texts.join(by_text, ["doc", "text_key"], "left").withColumn("pieces", F.when(F.col("p").isNotNull(), pieces))
    # The first part of an entity takes the text before it; the other words of a name take a space.
    filled = F.transform("p", lambda x: F.concat(F.when(x["part"] == 0, F.get("pieces", x["place"])).otherwise(" "), x["s"]))
    rebuilt = F.concat(F.array_join(filled, ""), F.element_at("pieces", -1))
    n = F.when(F.col("p").isNull(), 0).otherwise(F.size("pieces") - 1)
    return joined.select("doc_id", n.cast("long").alias("n_entities"), F.when(F.col("p").isNull(), F.col("text")).otherwise(rebuilt).alias("text"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates for personal data; without a key in the session, one for the synthetic tables."""
    return replace_entities(read(spark, sf_dir, "documents"), spark.conf.get(KEY_SETTING, "key of the synthetic tables"))


def queries() -> dict:
    return {"op8_pii": op8_pii}


def oracle_sql() -> dict[str, str]:
    return {}

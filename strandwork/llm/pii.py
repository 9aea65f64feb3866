"""Surrogates for personal data, in native column expressions and joins.

Detected entities (e-mail, phone, card, IBAN, US social security, IP addresses of both versions, titled name) get keyed
replacements of their own type: every letter and digit is drawn anew and keeps its class, case, script (Latin for scripts
without an alphabet here) and place, separators stay, card and account numbers pass their check digits, addresses stay
addresses, names follow the title's gender and the name's script. The same entity (normalised; a title's dot doesn't
count) gets the same surrogate everywhere, and a family name its own wherever it stands, so coreference holds between
``Mr John Smith`` and ``Mr Smith``. Surrogates that two entities would share, or that equal any entity in the corpus, are
drawn again under the next attempt until all are distinct; from attempt ``PLAIN`` on each is a character (an address, a
number, an initial) longer than under the attempt before, so there is room for all.

The key is a secret of the caller: who has it can repeat the draws and try names out.

The mapping of distinct entities is a table, joined to the entities found; it is never collected or broadcast. Texts
are cut at the entities and joined again, so an entity inside another's surrogate is never touched. Texts without a match
are not shuffled.

Defined results: null text stays null, empty text empty. Of overlapping entities the leftmost counts, then the order of
``KINDS``. A name is one or more titles and up to four names, with particles and initials; apostrophes and hyphens join
names. Numbers of 16 digits are cards whether or not their check digit holds, other lengths from 13 to 19 only if it does,
and in the groups that such cards are printed in. Rows are told apart by id and text; equal rows get equal texts. Extra
columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwork.llm.common import fresh, stored, whole

#: Titles with the gender they tell, and given names by gender and script.
TITLES = {
    "m": ["Mr", "Mister", "Sir", "Herr", "Señor", "Monsieur", "Господин"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "Mme", "Госпожа"],
    "n": ["Dr", "Prof"],
}
NAMES = {
    "m": {"latin": ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Gustav", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Oscar", "Paul", "Viktor"], "cyrillic": ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Павел"]},
    "f": {"latin": ["Anna", "Berta", "Clara", "Diana", "Elena", "Frida", "Greta", "Helena", "Irma", "Julia", "Klara", "Laura", "Maria", "Nora", "Paula", "Vera"], "cyrillic": ["Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Мария", "Ольга"]},
}
#: Both genders' names, for titles that tell none.
NAMES["n"] = {script: [*NAMES["m"][script], *NAMES["f"][script]] for script in NAMES["m"]}
#: Particles of names.
PARTICLES = ["de", "del", "della", "der", "den", "di", "da", "dos", "du", "la", "le", "van", "von", "ten", "ter", "zu", "al", "el", "bin", "ibn", "y", "e"]
_TITLES = r"(?:(?:" + "|".join(t for ts in TITLES.values() for t in ts) + r")\.? )+"
_NAME = r"\p{Lu}[\p{L}\p{M}]*(?:(?:-|['’](?!s(?!\p{L})))[\p{L}\p{M}]+)*+"
_PARTICLE = r"(?:(?:" + "|".join(PARTICLES) + r") )"
_FULL = rf"(?:(?:\p{{Lu}}\. ){{1,3}})?{_PARTICLE}{{0,3}}{_NAME}(?: (?:\p{{Lu}}\. ){{0,2}}{_PARTICLE}{{0,3}}{_NAME}){{0,3}}"
_HEX = "[0-9A-Fa-f]{1,4}"
#: Kinds in order of precedence, with what they look like.
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![0-9.+-])(?:[0-9]{4}(?:[0-9]{12}|(?: [0-9]{4}){3}|(?:-[0-9]{4}){3})|3[47][0-9]{2}(?: [0-9]{6} |-[0-9]{6}-)[0-9]{5}|3[0689][0-9]{2}(?: [0-9]{6} |-[0-9]{6}-)[0-9]{4}|[3-6][0-9]{12,18})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9.])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "ip6": rf"(?<![0-9A-Za-z:.])(?=[A-Fa-f:]*[0-9])(?:(?:{_HEX}:){{7}}{_HEX}|{_HEX}(?::{_HEX}){{0,5}}::(?:{_HEX}(?::{_HEX}){{0,5}})?|::{_HEX}(?::{_HEX}){{1,6}})(?![0-9A-Za-z:])",
    "name": rf"(?<!\p{{L}}){_TITLES}{_FULL}(?![\p{{L}}\p{{M}}])",
}
#: The kinds in this order, each tried only where its first character can stand; inside a word of small letters none can.
_NUMBERS = "|".join(f"(?:{KINDS[k]})" for k in ("card", "ssn", "phone", "ip"))
PATTERN = (
    rf"(?:(?<![a-z])|(?=[0-9A-Z+(:]))(?:(?:{KINDS['email']})|(?=[A-Z])(?:{KINDS['iban']})|(?=[0-9+(])(?:{_NUMBERS})"
    rf"|(?=[0-9A-Fa-f:])(?:{KINDS['ip6']})|(?=\p{{Lu}})(?:{KINDS['name']}))"
)
#: Attempts in all, and those that keep an entity's length.
ATTEMPTS, PLAIN = 24, 4


def _kind(entity: Column) -> Column:
    """An entity's kind; null for a number that is no card after all."""
    first, *rest = [(k, entity.rlike(f"^(?:{p})$")) for k, p in KINDS.items()]
    out = F.when(first[1], first[0])
    for k, c in rest:
        out = out.when(c, k)
    digits = F.regexp_replace(entity, "[^0-9]", "")
    return F.when((out == "card") & (F.length(digits) != 16) & ~_luhn(digits).eqNullSafe(digits), None).otherwise(out)


def _norm(kind: Column, entity: Column) -> Column:
    """What makes two mentions the same entity; of a name its gender and the names."""
    title = F.regexp_extract(entity, r"^(\p{L}+)", 1)
    gender = F.when(title.isin(TITLES["m"]), "m").when(title.isin(TITLES["f"]), "f").otherwise("n")
    return (
        F.when(kind.isin("email", "ip6"), F.lower(entity))
        .when(kind.isin("card", "ssn", "phone"), F.regexp_replace(entity, "[^0-9]", ""))
        .when(kind == "iban", F.replace(entity, F.lit(" "), F.lit("")))
        .when(kind == "name", F.concat(gender, F.lit("|"), F.regexp_replace(entity, f"^{_TITLES}", "")))
        .otherwise(entity)
    )


def _draws(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    """48 numbers from 0 to 65535 drawn by key, entity and attempt."""
    seed = F.concat_ws("|", F.lit(key), kind, norm, attempt.cast("string"))
    digest = F.concat(*[F.sha2(F.concat(seed, F.lit(f"|{i}")), 256) for i in range(3)])
    return F.transform(F.sequence(F.lit(0), F.lit(47)), lambda i: F.conv(F.substr(digest, i * 4 + 1, F.lit(4)), 16, 10).cast("int"))


#: Characters that stand for one another.
_LETTERS = [
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "0123456789",
    "абвгдеёжзийклмнопрстуфхцчшщъыьэюя",
    "АБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ",
    "àáâäçèéêëìíîïñòóôöùúûüß",
    "ÀÁÂÄÇÈÉÊËÌÍÎÏÑÒÓÔÖÙÚÛÜ",
]
#: What stands for the other letters and numbers, by the first pattern they match.
_OTHERS = [
    (r"[\p{IsGreek}&&\p{Lu}]", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"),
    (r"[\p{IsGreek}&&\p{L}]", "αβγδεζηθικλμνξοπρστυφχψω"),
    (r"[\p{IsCyrillic}&&\p{Lu}]", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"),
    (r"[\p{IsCyrillic}&&\p{L}]", "абвгдежзиклмнопрстуфхцчшэюя"),
    (r"[\p{IsArmenian}&&\p{Lu}]", "ԱԲԳԴԵԶԷԸԹԺԻԼԽԾԿՀՁՂՃՄՅՆՇՈՉՊՋՌՍՎՏՐՑՓՔՕՖ"),
    (r"[\p{IsArmenian}&&\p{L}]", "աբգդեզէըթժիլխծկհձղճմյնշոչպջռսվտրցփքօֆ"),
    (r"[\p{IsGeorgian}&&\p{Lo}]", "აბგდევზთიკლმნოპჟრსტუფქღყშჩცძწჭხჯჰ"),
    (r"[\p{IsHebrew}&&\p{L}]", "אבגדהוזחטיכלמנסעפצקרשת"),
    (r"[\p{IsArabic}&&\p{L}]", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"),
    (r"[\p{IsDevanagari}&&\p{L}]", "कखगघचछजझटठडढतथदधनपफबभमयरलवशषसह"),
    (r"[\p{IsHiragana}&&\p{L}]", "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめも"),
    (r"[\p{IsKatakana}&&\p{L}]", "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモ"),
    (r"[\p{IsHangul}&&\p{L}]", "가나다라마바사아자차카타파하고노도로모보소오조초코토포호"),
    (r"\p{IsHan}", "一二三四五六七八九十山川田中上下大小木林森水火土金石月日"),
    (r"[\p{Lu}\p{Lt}]", _LETTERS[1]),
    (r"\p{L}", _LETTERS[0]),
    (r"\p{N}", _LETTERS[2]),
]


def _masked(text: Column, draws: Column) -> Column:
    """text with each letter and digit replaced by a drawn one of its class; other characters stay."""

    def one(c: Column, i: Column) -> Column:
        d = F.element_at(draws, (i % 48) + 1)
        out = None
        for found, letters in [(F.instr(F.lit(x), c) > 0, x) for x in _LETTERS] + [(c.rlike(p), x) for p, x in _OTHERS]:
            drawn = F.substr(F.lit(letters), d % len(letters) + 1, F.lit(1))
            out = F.when(found, drawn) if out is None else out.when(found, drawn)
        return out.otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn(number: Column) -> Column:
    """Digits with the last one set so that the check holds."""
    body = F.reverse(F.substr(number, F.lit(1), F.length(number) - 1))
    doubled = F.transform(F.split(body, ""), lambda c, i: c.cast("int") * (2 - i % 2))
    total = F.aggregate(doubled, F.lit(0), lambda a, x: a + F.floor(x / 10).cast("int") + x % 10)
    return F.concat(F.substr(number, F.lit(1), F.length(number) - 1), ((10 - total % 10) % 10).cast("string"))


def _checked(country: Column, account: Column) -> Column:
    """An account number with the two digits after its country that make the remainder by 97 one."""
    value = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    rest = lambda a, c: (a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97
    left = F.aggregate(F.split(F.concat(account, country, F.lit("00")), ""), F.lit(0), lambda a, c: rest(a, c).cast("int"))
    return F.concat(country, F.lpad((98 - left).cast("string"), 2, "0"), account)


def surrogate(kind: Column, norm: Column, attempt: Column, family: Column, key: str) -> Column:
    """The surrogate of a normalised entity; formats such as separators are laid over it for each mention.

    kind ``family``: a family name; kind ``name``: gender and names, with the surrogate of the family name given.
    """
    more = F.greatest(attempt - PLAIN + 1, F.lit(0))
    spare = F.when(kind == "family", F.lower(F.substr(norm, F.length(norm)))).when(kind == "email", "x").when(kind == "ip", ".0").when(kind == "name", "").otherwise("0")
    longer = F.when(kind == "email", F.concat(F.repeat(spare, more), norm)).otherwise(F.concat(norm, F.repeat(spare, more)))
    drawn = F.struct(_draws(kind, norm, attempt, key).alias("d"), longer.alias("norm"), more.alias("more"))
    return F.transform(F.array(drawn), lambda v: _surrogate(kind, v["norm"], v["d"], family, v["more"]))[0]


def _full_name(norm: Column, d: Column, family: Column, more: Column) -> Column:
    """Gender and names anew: the first whole given name is one of its gender and script, the others and initials are
    masked, particles stay, and later attempts have further initials."""
    gender, names = F.substring_index(norm, "|", 1), F.split(F.substring_index(norm, "|", -1), " ")
    given = F.slice(names, F.lit(1), F.size(names) - 1)
    script = F.when(norm.rlike(r"\|\p{IsCyrillic}"), "cyrillic").when(norm.rlike(r"\|\p{IsLatin}"), "latin")
    own = None
    for g, scripts in NAMES.items():
        for s, known in scripts.items():
            drawn = F.element_at(F.array([F.lit(n) for n in known]), F.element_at(d, 1) % len(known) + 1)
            own = F.when((gender == g) & (script == s), drawn) if own is None else own.when((gender == g) & (script == s), drawn)
    whole_name = lambda w: w.rlike(r"^\p{Lu}") & ~w.endswith(".")
    first = F.array_position(F.transform(given, whole_name), True) - 1
    turned = lambda i: F.concat(F.slice(d, i % 40 + 2, 47 - i % 40), F.slice(d, F.lit(1), i % 40 + 1))
    new = F.transform(given, lambda w, i: F.when(w.rlike(r"^\p{Ll}"), w).when((i == first) & own.isNotNull(), own).otherwise(_masked(w, turned(i))))
    letters = F.lit(_LETTERS[1])
    initials = F.when(more > 0, F.transform(F.sequence(F.lit(1), F.greatest(more, F.lit(1))), lambda i: F.concat(F.substr(letters, F.element_at(d, i + 20) % 26 + 1, F.lit(1)), F.lit(".")))).otherwise(F.array().cast("array<string>"))
    return F.concat(gender, F.lit("|"), F.array_join(F.concat(new, initials, F.array(family)), " "))


def _surrogate(kind: Column, norm: Column, d: Column, family: Column, more: Column) -> Column:
    masked = _masked(norm, d)
    at = F.instr(norm, "@")
    # the host's letters are drawn too; its last label becomes one that no host has
    email = F.concat(F.substring_index(masked, "@", 1), F.lit("@"), F.regexp_replace(F.substr(masked, at + 1), r"[^.]+$", "example"))
    ip = F.array_join(F.transform(F.sequence(F.lit(1), F.size(F.split(norm, r"\."))), lambda i: F.when(i == 1, 1 + F.element_at(d, i) % 223).otherwise(F.element_at(d, i) % 256).cast("string")), ".")
    hexes = F.array_join(F.transform(F.split(norm, ""), lambda c, i: F.when(c == ":", c).otherwise(F.substr(F.lit("0123456789abcdef"), F.element_at(d, i % 48 + 1) % 16 + 1, F.lit(1)))), "")
    number = lambda keep: F.concat(F.substr(norm, F.lit(1), F.lit(keep)), F.substr(masked, F.lit(keep + 1)))
    return (
        F.when(kind == "email", email)
        .when(kind == "card", _luhn(masked))
        .when(kind == "ip", ip)
        .when(kind == "ip6", hexes)
        .when(kind == "phone", number(1))
        .when(kind == "iban", _checked(F.substr(norm, F.lit(1), F.lit(2)), F.substr(masked, F.lit(5))))
        .when(kind == "name", _full_name(norm, d, family, more))
        .otherwise(masked)
    )


def _laid_over(kind: Column, mention: Column, value: Column) -> Column:
    """A surrogate of digits or letters with a mention's separators, a name with its title; other kinds as they are."""
    place = F.transform(F.split(mention, ""), lambda c: c.rlike("[A-Za-z0-9]").cast("int"))
    # the n-th letter or digit of the mention takes the n-th of the surrogate
    laid = F.aggregate(
        F.zip_with(F.split(mention, ""), place, lambda c, p: F.struct(c.alias("c"), p.alias("p"))),
        F.struct(F.lit(0).alias("n"), F.lit("").alias("out")),
        lambda a, x: F.struct((a["n"] + x["p"]).alias("n"), F.concat(a["out"], F.when(x["p"] == 1, F.substr(value, a["n"] + 1, F.lit(1))).otherwise(x["c"])).alias("out")),
        lambda a: F.concat(a["out"], F.substr(value, a["n"] + 1)),  # a longer surrogate goes on behind
    )
    titled = F.concat(F.regexp_extract(mention, f"^({_TITLES})", 1), F.substring_index(value, "|", -1))
    return F.when(kind.isin("card", "ssn", "phone", "iban"), laid).when(kind == "name", titled).otherwise(value)


def _agreed(entities: DataFrame, key: str) -> DataFrame:
    """entities (kind, norm, family), distinct -> kind, norm, value: all values distinct within a kind, none an entity."""
    kept = None
    open_ = entities.select("kind", "norm", "family")
    for attempt in range(ATTEMPTS):
        drawn = stored(open_.select("kind", "norm", "family", surrogate(F.col("kind"), F.col("norm"), F.lit(attempt), F.col("family"), key).alias("value")), "drawn")
        taken = entities.select(F.col("kind"), F.col("norm").alias("value"), F.lit(True).alias("real"))
        if kept is not None:
            taken = taken.union(kept.select("kind", "value", F.lit(True)))
        first = drawn.groupBy("kind", "value").agg(F.min("norm").alias("first"))
        checked = (
            drawn.join(first, ["kind", "value"])
            .join(taken.distinct(), ["kind", "value"], "left")
            .withColumn("ok", F.col("real").isNull() & (F.col("norm") == F.col("first")))
            .select("kind", "norm", "family", "value", "ok")
        )
        checked = stored(checked, "checked")
        good = checked.where("ok").select("kind", "norm", "value")
        kept = good if kept is None else kept.union(good)
        open_ = checked.where("NOT ok").select("kind", "norm", "family")
        if not open_.limit(1).count():
            return kept
    raise ValueError("too few surrogates for the entities of a kind")


def _mapping(entities: DataFrame, key: str) -> DataFrame:
    """entities (kind, norm), distinct -> kind, norm, value. Family names first, then names with their family's."""
    none = F.lit(None).cast("string")
    name = F.col("kind") == "name"
    names = entities.where(name).withColumn("last", F.substring_index(F.substring_index("norm", "|", -1), " ", -1))
    families = stored(_agreed(stored(names.select(F.lit("family").alias("kind"), F.col("last").alias("norm"), none.alias("family")).distinct(), "families"), key), "families")
    names = names.join(families.select(F.col("norm").alias("last"), F.col("value").alias("family")), "last").select("kind", "norm", "family")
    return _agreed(stored(entities.where(~name).select("kind", "norm", none.alias("family")).unionByName(names), "entities"), key)


def pseudonymise(docs: DataFrame, key: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with the new text and the number of entities; and the names of these columns."""
    name: dict[str, str] = {}
    for want in ("new_text", "n_entities", "row_key", "of_id", "of_key", "values", "n_found"):
        name[want] = fresh([*docs.columns, *name.values()], want)
    text, pattern = whole("text"), F.lit(PATTERN)
    matching = docs.where(text.rlike(PATTERN))
    found = matching.select("doc_id", F.xxhash64(text).alias("k"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("m")).dropDuplicates(["doc_id", "k"])
    found = found.select("doc_id", "k", F.posexplode("m").alias("at", "mention")).withColumn("kind", _kind(F.col("mention")))
    found = stored(found.withColumn("norm", _norm(F.col("kind"), F.col("mention"))), "mentions")
    mapping = stored(_mapping(found.where("kind IS NOT NULL").select("kind", "norm").distinct(), key), "surrogates")
    value = F.coalesce(_laid_over(F.col("kind"), F.col("mention"), F.col("value")), F.col("mention"))
    values = (
        found.join(mapping, ["kind", "norm"], "left")
        .select("doc_id", "k", "kind", F.struct("at", value.alias("v")).alias("x"))
        .groupBy("doc_id", "k")
        .agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"]).alias("values"), F.count("kind").alias("n"))
        .toDF(*[name[x] for x in ("of_id", "of_key", "values", "n_found")])
    )
    v, n = F.col(name["values"]), F.col(name["n_found"])
    pieces = F.split(text, PATTERN, -1)
    put = F.array_join(F.flatten(F.zip_with(pieces, v, lambda p, x: F.array(p, F.coalesce(x, F.lit(""))))), "")
    same = F.col("doc_id").eqNullSafe(F.col(name["of_id"])) & (F.col(name["row_key"]) == F.col(name["of_key"]))
    changed = (
        matching.withColumn(name["row_key"], F.xxhash64(text))
        .join(values, same)
        .withColumn(name["new_text"], F.when(n > 0, put).otherwise(F.col("text")))
        .withColumn(name["n_entities"], n)
        .drop(*[name[x] for x in ("row_key", "of_id", "of_key", "values", "n_found")])
    )
    others = docs.where(~text.rlike(PATTERN)).withColumn(name["new_text"], F.col("text")).withColumn(name["n_entities"], F.lit(0).cast("long"))
    return changed.unionByName(others), name


def pii_report(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, the text with surrogates and the number of replaced entities."""
    out, name = pseudonymise(docs.select("doc_id", "text"), key)
    return out.select("doc_id", F.col(name["new_text"]).alias("text"), F.col(name["n_entities"]).alias("n_entities"))

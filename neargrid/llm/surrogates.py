r"""Surrogates for personal data, with DataFrame functions only.

Found are e-mail addresses, telephone numbers, card numbers, IPv4 addresses, social security numbers, IBANs, access keys,
secrets behind names such as `password=` or `token = "`, names behind a title, and in the same document the words of such
names where they stand alone. Each becomes another value of its type: digits for digits, letters of the same case and
script for letters, marks where they were. Words of names keep the gender of their titles and their script; e-mail
addresses keep their top-level domain, hexadecimal secrets stay hexadecimal, IPv4 addresses stay valid, telephone numbers
keep their country code, card numbers pass the Luhn check and IBANs the check modulo 97.

A surrogate is a function of a secret key that the caller gives, the type, the canonical value (lower case, digits only, ...)
and an attempt, so one value is replaced alike everywhere, however it is written. Candidates that two values share, or that
are the value of another entity, go to the next attempt, until all surrogates differ from each other and from every value
found. Every eighth attempt adds a character to secrets and e-mail addresses, and every attempt a syllable to names, so that
short values cannot run out of surrogates; a secret without letters and digits becomes letters.

Names are up to 21 words behind one title or more, with inner capitals, apostrophes, initials and particles. Their last word is a
family name, the others are given names (a word that the document has as a given name is one), and each word has its own
surrogate: `Mr Smith`, `Dr John Smith` and a later `Smith` stay one family. The gender of a given name is that of its titles,
none if they differ; where no title tells it, that of the name in a list of common ones. Behind a title in capitals (`MR JOHN SMITH`) three words
are taken at most, as a whole sentence may be in capitals. An initial moves along the alphabet by a secret distance. A name that never has a title is not found.

1. Each text is scanned once, and once more if it holds names; texts and the values found are stored.
2. The distinct values get their surrogates: one aggregation, and one round for each attempt.
3. Values meet their surrogates by a join (adaptive execution splits frequent ones), come back to their document by its row
   number, and the text is put together from the parts between the values. Texts without any value are not shuffled.

Null texts stay null, with 0 values. Rows with one doc_id twice, or none, are documents of their own. Empty tables give no
rows. Only doc_id and text are read. All repeats of groups in patterns are bounded, so no text can exhaust a stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage

# Titles by gender, and first names by gender and script.
MALE_TITLES = ["Mr", "Mister", "Herr", "Monsieur", "Señor", "Господин", "Sir", "Lord", "Sr", "Signor"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Госпожа", "Madam", "Lady", "Mme", "Mlle", "Señorita", "Sra", "Signora"]
#: Titles of any gender.
OTHER_TITLES = ["Dr", "Doctor", "Prof", "Professor", "Доктор", "Профессор"]
FIRST_NAMES = {
    ("m", "latin"): ["Adam", "Bruno", "Carl", "David", "Erik", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Leon", "Martin", "Oscar", "Paul", "Simon", "Victor"],
    ("f", "latin"): ["Alice", "Bella", "Clara", "Diana", "Emma", "Flora", "Greta", "Helena", "Ida", "Julia", "Laura", "Maria", "Nora", "Olivia", "Sofia", "Vera"],
    ("m", "cyrillic"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Иван", "Кирилл", "Максим", "Олег", "Павел"],
    ("f", "cyrillic"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга", "Юлия"],
}
# Given names whose gender is known without a title, beside those above.
GIVEN_NAMES = {
    "m": ["John", "Peter", "James", "Robert", "Michael", "William", "Richard", "Thomas", "Daniel", "Mark", "George", "Andrew", "Kevin", "Brian", "Hans", "Karl", "Klaus", "Jürgen", "Wolfgang", "Stefan", "Andreas", "Pierre", "Jean", "Louis", "Jacques", "Philippe", "José", "Juan", "Carlos", "Pedro", "Miguel", "Александр", "Дмитрий", "Сергей", "Николай"],
    "f": ["Anna", "Mary", "Elizabeth", "Jennifer", "Linda", "Susan", "Sarah", "Karen", "Margaret", "Jane", "Emily", "Kate", "Eva", "Ursula", "Monika", "Petra", "Sabine", "Ingrid", "Marie", "Claire", "Sophie", "Camille", "Isabelle", "Catherine", "Carmen", "Ana", "Lucia", "Elena", "Isabel", "Rosa", "Татьяна", "Наталья", "Светлана", "Екатерина"],
}
GIVEN_NAMES = {g: sorted({n.lower() for n in names} | {n.lower() for (own, _), first in FIRST_NAMES.items() if own == g for n in first}) for g, names in GIVEN_NAMES.items()}
FIRST_NAMES |= {("n", script): FIRST_NAMES["m", script] + FIRST_NAMES["f", script] for script in ("latin", "cyrillic")}
SYLLABLES = {
    "latin": ["ba", "bel", "cor", "da", "den", "fal", "gar", "hol", "jan", "kel", "lan", "mar", "nor", "pel", "ran", "sol", "tam", "ver", "win", "zan"],
    "cyrillic": ["ба", "вел", "гор", "да", "жен", "зар", "кол", "лан", "мар", "нов", "пет", "рад", "сол", "тим", "фед", "чер"],
}



def _either(titles: list[str]) -> str:
    """Titles as they are, or in capitals."""
    return "|".join(titles + [t.upper() for t in titles])


_TITLES = _either(MALE_TITLES + FEMALE_TITLES + OTHER_TITLES)
_TITLED = rf"(?:(?:{_TITLES})\.? ){{1,5}}"
_CAPITALS = rf"(?:(?:{'|'.join(t.upper() for t in MALE_TITLES + FEMALE_TITLES + OTHER_TITLES)})\.? ){{1,5}}"
# a capital, and what follows in the word: an apostrophe only ahead of another capital (O'Brien, not Smith's)
_WORD = r"(?:\p{Lu}\.(?= \p{Lu})|\p{Lu}(?:[\p{L}\p{M}]|['’](?=\p{Lu})){0,40}+)"
_PARTICLES = r"(?:(?:van|von|der|den|de|del|della|di|da|dos|du|la|le|bin|ibn|al|el|zu) ){0,3}"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_SECRET_NAMES = "password|passwd|pwd|secret|token|api_key|apikey"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){1,127}+",
    "secret": rf"(?<=(?:{_SECRET_NAMES})=)[^\s\"',;]{{4,}}+|(?<=(?:{_SECRET_NAMES}) = \")[^\"\s]{{4,}}+(?=\")",
    "key": r"(?<![A-Za-z0-9])A[KS]IA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:(?: ?[0-9A-Z]{4}){3,7}(?:[0-9A-Z]{1,3}| [0-9]{1,3})?|(?: ?[0-9A-Z]{4}){2}(?:[0-9A-Z]{3}| [0-9]{3}))(?![A-Za-z0-9])",
    "ip": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?[0-9])",
    "card": r"(?<![0-9-])(?:[0-9]{4}(?:[ -]?[0-9]{4}){3}|3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5})(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9+])\+[0-9]{2,3}(?:[ .-]?[0-9]{2,4}){3,5}(?![0-9])",
    "name": rf"(?<![\p{{L}}])(?:{_CAPITALS}{_WORD}(?:[ -]{_WORD}){{0,2}}+|{_TITLED}{_PARTICLES}{_WORD}(?:[ -]{_PARTICLES}{_WORD}){{0,20}}+)",
}
ANY = "|".join(PATTERNS.values())
#: A text without any of these holds nothing to be found; most texts are passed over by this alone.
HINT = f"[0-9@=\"]|{_TITLES}"


def _literal(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _list(words: list[str]) -> str:
    return "array(" + ", ".join(map(_literal, words)) + ")"


def kind_of(value: str) -> Column:
    """The type of a found value, in the order of the patterns."""
    whole = {k: f"^(?:{p})$" for k, p in PATTERNS.items() if k != "secret"}
    tests = " ".join(f"WHEN {value} RLIKE {_literal(p)} THEN '{k}'" for k, p in whole.items())
    return F.expr(f"CASE {tests} ELSE 'secret' END")


#: The value without what its way of writing adds. Telephone numbers: the last ten digits.
CANONICAL = rf"""CASE kind
    WHEN 'email' THEN lower(value)
    WHEN 'phone' THEN right(regexp_replace(value, '[^0-9]', ''), 10)
    WHEN 'card' THEN regexp_replace(value, '[^0-9]', '')
    WHEN 'ssn' THEN regexp_replace(value, '[^0-9]', '')
    WHEN 'iban' THEN replace(value, ' ', '')
    ELSE value END"""

_BYTE = "cast(conv(substr(h, 2 * (i % 64) + 1, 2), 16, 10) AS int)"
_CHARS = rf"""array_join(transform(split(part, ''), (c, i) -> CASE
    WHEN c RLIKE '[0-9]' THEN cast({_BYTE} % 10 AS string)
    WHEN hexadecimal AND c RLIKE '[a-f]' THEN char(97 + {_BYTE} % 6)
    WHEN c RLIKE '[a-z]' THEN char(97 + {_BYTE} % 26)
    WHEN c RLIKE '[A-Z]' THEN char(65 + {_BYTE} % 26)
    WHEN c RLIKE '[а-я]' THEN substr('абвгдежзиклмнопрстуфхцчшэюя', 1 + {_BYTE} % 27, 1)
    WHEN c RLIKE '[\\p{{Ll}}]' THEN char(97 + {_BYTE} % 26)
    WHEN c RLIKE '[\\p{{Lu}}]' THEN char(65 + {_BYTE} % 26)
    WHEN c RLIKE '[\\p{{N}}]' THEN cast({_BYTE} % 10 AS string)
    WHEN c RLIKE '[\\p{{L}}]' OR bare THEN char(97 + {_BYTE} % 26)
    ELSE c END), '')"""


#: Attempts after which secrets and e-mail addresses grow.
WIDEN = 8


def _syllables(script: str, least: int, at: int) -> str:
    """Syllables chosen by the hash: `least` of them, and one more with every attempt, so that many names need few attempts."""
    words, n = _list(SYLLABLES[script]), len(SYLLABLES[script])
    more = "least(attempt, 24)"
    many = f"transform(sequence(1, {least} + {more}), j -> element_at({words}, 1 + cast(conv(substr(h, {at} + 4 * (j - 1), 4), 16, 10) AS int) % {n}))"
    return f"array_join({many if least else f'CASE WHEN {more} > 0 THEN {many} ELSE array() END'}, '')"


def _given_name() -> str:
    def one(gender: str, script: str) -> str:
        first = FIRST_NAMES[gender, script]
        return f"concat(lower(element_at({_list(first)}, 1 + cast(conv(substr(h, 1, 4), 16, 10) AS int) % {len(first)})), {_syllables(script, 0, 9)})"

    cases = " ".join(f"WHEN gender = '{g}' AND {'' if s == 'cyrillic' else 'NOT '}canonical RLIKE '[а-я]' THEN {one(g, s)}" for g, s in FIRST_NAMES)
    return f"CASE {cases} END"


FAMILY_NAME = f"CASE WHEN canonical RLIKE '[а-я]' THEN {_syllables('cyrillic', 3, 9)} ELSE {_syllables('latin', 3, 9)} END"

# ---- parts of a name, over `value`
_BODY = f"regexp_replace(value, {_literal('^' + _TITLED)}, '')"
_PIECE = _literal(f"(.*?)({_WORD})")
_GENDER = f"""CASE WHEN value RLIKE {_literal("^(?:(?:" + _TITLES + ")[.]? )*(?:" + _either(MALE_TITLES) + ")[. ]")} THEN 'm'
    WHEN value RLIKE {_literal("^(?:(?:" + _TITLES + ")[.]? )*(?:" + _either(FEMALE_TITLES) + ")[. ]")} THEN 'f' ELSE 'n' END"""
IS_NAME = f"value RLIKE {_literal('^' + PATTERNS['name'] + '$')}"
#: Words of a titled name with their kinds.
NAME_WORDS = f"transform(regexp_extract_all({_BODY}, {_PIECE}, 2), (w, i) -> struct(w AS word, CASE WHEN w RLIKE '[.]$' THEN 'initial' WHEN i + 1 = size(regexp_extract_all({_BODY}, {_PIECE}, 2)) THEN 'family' ELSE 'given' END AS kind))"


def _kind_in_document(word: str) -> str:
    return f"CASE WHEN exists(own, o -> o.word = {word} AND o.kind = 'given') THEN 'given' ELSE 'family' END"


#: The pieces of a value that have surrogates of their own, each with the text ahead of it.
PIECES = f"""CASE WHEN kind = 'name' THEN transform({NAME_WORDS}, (x, i) -> struct(
        concat(CASE WHEN i = 0 THEN regexp_extract(value, {_literal("^" + _TITLED)}, 0) ELSE '' END, element_at(regexp_extract_all({_BODY}, {_PIECE}, 1), i + 1)) AS lead,
        x.word AS value, CASE WHEN x.kind = 'initial' THEN x.kind ELSE {_kind_in_document("x.word")} END AS kind, lower(x.word) AS canonical, {_GENDER} AS gender))
    WHEN kind = 'mention' THEN array(struct('' AS lead, value AS value, {_kind_in_document("value")} AS kind, lower(value) AS canonical, 'n' AS gender))
    ELSE array(struct('' AS lead, value AS value, kind AS kind, canonical AS canonical, 'n' AS gender)) END"""


#: The digit that makes a number pass the Luhn check, in place of its last one.
_LUHN = """cast((10 - aggregate(transform(split(reverse(substr(made, 1, length(made) - 1)), ''), (c, i) -> CASE
    WHEN NOT c RLIKE '[0-9]' THEN 0 WHEN i % 2 = 1 THEN cast(c AS int) ELSE 2 * cast(c AS int) div 10 + 2 * cast(c AS int) % 10 END), cast(0 AS bigint), (s, v) -> s + v) % 10) % 10 AS string)"""
#: The third and fourth character of an IBAN: 98 less the remainder of all others, the country behind them and its digits 0.
_MOD_97 = """lpad(cast(98 - aggregate(split(concat(substr(made, 5), substr(made, 1, 2), '00'), ''), cast(0 AS bigint), (s, c) -> CASE
    WHEN c RLIKE '[0-9]' THEN (10 * s + cast(c AS int)) % 97 WHEN c RLIKE '[A-Z]' THEN (100 * s + ascii(c) - 55) % 97 ELSE s END) AS string), 2, '0')"""
CHECKED = f"""CASE kind WHEN 'card' THEN concat(substr(made, 1, length(made) - 1), {_LUHN})
    WHEN 'iban' THEN concat(substr(made, 1, 2), {_MOD_97}, substr(made, 5)) ELSE made END"""


def candidates(values: DataFrame, key: str) -> DataFrame:
    """(kind, canonical, gender, attempt) with the candidate of this attempt."""
    octets = ", ".join(f"1 + cast(conv(substr(h, {1 + 4 * j}, 4), 16, 10) AS int) % 254" for j in range(4))
    hashed = values.withColumn("h", F.sha2(F.concat_ws("|", F.lit(key), "kind", "canonical", F.col("attempt").cast("string")), 512))
    # a key keeps its prefix, a card its first digit, an IBAN its country, an e-mail address its top-level domain
    parts = hashed.withColumn("head", F.expr("CASE kind WHEN 'key' THEN 4 WHEN 'card' THEN 1 WHEN 'iban' THEN 2 ELSE 0 END"))
    parts = parts.withColumn("tail", F.expr("CASE kind WHEN 'email' THEN length(substring_index(canonical, '.', -1)) ELSE 0 END"))
    parts = parts.withColumn("part", F.expr("substr(canonical, head + 1, length(canonical) - head - tail)"))
    parts = parts.withColumn("hexadecimal", F.expr("kind = 'secret' AND canonical RLIKE '^[0-9a-f]+$'"))
    parts = parts.withColumn("bare", F.expr(f"kind = 'secret' AND NOT canonical RLIKE {_literal('[\\p{L}\\p{N}]')}"))
    wider = f"CASE WHEN kind IN ('email', 'secret') THEN substr(h, 101, least(attempt div {WIDEN}, 24)) ELSE '' END"
    made = F.expr(f"CASE kind WHEN 'ip' THEN concat_ws('.', {octets}) WHEN 'given' THEN {_given_name()} WHEN 'family' THEN {FAMILY_NAME} ELSE concat({wider}, substr(canonical, 1, head), {_CHARS}, right(canonical, tail)) END")
    return parts.select("kind", "canonical", "gender", "attempt", made.alias("made")).withColumn("surrogate", F.expr(CHECKED)).drop("made")


def surrogates(values: DataFrame, key: str) -> DataFrame:
    """kind, canonical, surrogate for distinct (kind, canonical), and a gender: no surrogate twice, none that is itself a
    value."""
    if "gender" not in values.columns:
        values = values.withColumn("gender", F.lit("n"))
    waiting, done, attempt = values.withColumn("attempt", F.lit(0)), None, 0
    while True:
        tried = candidates(waiting, key)
        free = tried.join(values.select("kind", F.col("canonical").alias("surrogate")), ["kind", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        first = free.withColumn("nth", F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("canonical")))
        won = stage(first.where("nth = 1").select("kind", "canonical", "surrogate"))
        done = won if done is None else done.unionByName(won)
        attempt += 1
        lost = waiting.join(won, ["kind", "canonical"], "left_anti").select("kind", "canonical", "gender", F.lit(attempt).alias("attempt"))
        lost = stage(lost)
        if lost.isEmpty():
            return done
        waiting = lost


#: Of all places where a name occurs: by titles, else by the name itself.
GENDER_OF_NAME = f"""CASE WHEN max(gender = 'm') AND max(gender = 'f') THEN 'n' WHEN max(gender = 'm') THEN 'm' WHEN max(gender = 'f') THEN 'f'
    WHEN kind = 'given' AND array_contains({_list(GIVEN_NAMES['m'])}, canonical) THEN 'm' WHEN kind = 'given' AND array_contains({_list(GIVEN_NAMES['f'])}, canonical) THEN 'f' ELSE 'n' END"""


#: A surrogate in the way its value is written: digits from the right, or character by character in the same case.
WRITTEN = r"""CASE
    WHEN kind = 'ip' THEN surrogate
    WHEN kind IN ('phone', 'card', 'ssn') THEN array_join(transform(split(value, ''), (c, i) ->
        CASE WHEN c RLIKE '[0-9]' AND length(regexp_replace(substr(value, i + 2), '[^0-9]', '')) < length(surrogate)
             THEN substr(surrogate, length(surrogate) - length(regexp_replace(substr(value, i + 2), '[^0-9]', '')), 1) ELSE c END), '')
    WHEN kind = 'iban' THEN array_join(transform(split(value, ''), (c, i) ->
        CASE WHEN c = ' ' THEN c ELSE substr(surrogate, i + 1 - (length(substr(value, 1, i)) - length(replace(substr(value, 1, i), ' ', ''))), 1) END), '')
    WHEN kind = 'email' THEN concat(substr(surrogate, 1, length(surrogate) - length(value)), array_join(transform(split(value, ''), (c, i) ->
        CASE WHEN c RLIKE '[A-Z]' THEN upper(substr(surrogate, length(surrogate) - length(value) + i + 1, 1))
             ELSE substr(surrogate, length(surrogate) - length(value) + i + 1, 1) END), ''))
    WHEN kind IN ('given', 'family') THEN CASE WHEN upper(value) = value AND length(value) > 1 THEN upper(surrogate) ELSE initcap(surrogate) END
    ELSE surrogate END"""


def _initial(key: str) -> str:
    """An initial, moved along its alphabet by a distance that depends on the key."""
    import hashlib

    far = 1 + int(hashlib.sha256(f"{key}|initial".encode()).hexdigest(), 16) % 25
    latin = f"concat(char(65 + (ascii(upper(value)) - 65 + {far}) % 26), '.')"
    letters = "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"
    cyrillic = f"concat(substr('{letters}', 1 + (greatest(locate(upper(substr(value, 1, 1)), '{letters}'), 1) - 1 + {far}) % {len(letters)}, 1), '.')"
    return f"CASE WHEN value RLIKE '^[A-Z]' THEN {latin} WHEN value RLIKE '^[А-Я]' THEN {cyrillic} ELSE '{chr(65 + far)}.' END"


def pseudonymize(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text with surrogates, n_values."""
    if not key:
        raise ValueError("surrogates need a secret key")
    found = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    found = found.withColumn("values", F.expr(f"CASE WHEN text RLIKE {_literal(HINT)} THEN regexp_extract_all(text, {_literal(ANY)}, 0) END"))
    # the words of a document's titled names, and with them what is looked for in this document
    found = found.withColumn("own", F.expr(f"array_distinct(flatten(transform(filter(values, value -> {IS_NAME}), value -> filter({NAME_WORDS}, x -> x.kind <> 'initial'))))"))
    words = r"array_join(transform(array_sort(array_distinct(transform(own, o -> o.word)), (x, y) -> CASE WHEN length(x) <> length(y) THEN length(y) - length(x) ELSE CASE WHEN x < y THEN -1 WHEN x > y THEN 1 ELSE 0 END END), w -> concat('\\Q', w, '\\E')), '|')"
    found = found.withColumn("mentions", F.expr(f"CASE WHEN size(own) > 0 THEN concat({_literal(r'|(?<![\p{L}\p{M}])(?:')}, {words}, {_literal(r')(?![\p{L}\p{M}])')}) ELSE '' END"))
    found = found.withColumn("values", F.expr(f"CASE WHEN mentions <> '' THEN regexp_extract_all(text, concat({_literal(ANY)}, mentions), 0) ELSE values END"))
    found = stage(found.withColumn("n_values", F.expr("greatest(coalesce(size(values), 0), 0)")))
    some = found.where("n_values > 0")
    each = some.select("row", "own", F.posexplode("values").alias("nth", "value"))
    each = each.withColumn("kind", F.when(F.expr("exists(own, o -> o.word = value)"), "mention").when(F.expr(IS_NAME), "name").otherwise(kind_of("value")))
    each = each.withColumn("canonical", F.expr(CANONICAL)).select("row", "nth", F.posexplode(F.expr(PIECES)).alias("i", "p")).select("row", "nth", "i", "p.*")
    each = stage(each)
    values = each.where("kind <> 'initial'").groupBy("kind", "canonical").agg(F.expr(GENDER_OF_NAME).alias("gender"))
    table = stage(surrogates(stage(values), key))
    written = each.join(table, ["kind", "canonical"], "left").withColumn("w", F.expr(f"concat(lead, CASE WHEN kind = 'initial' THEN {_initial(key)} ELSE {WRITTEN} END)"))
    # both sums are made where the rows of a document meet
    whole = written.select("row", "nth", "i", "w").repartition("row").groupBy("row", "nth").agg(F.expr("array_join(transform(sort_array(collect_list(struct(i, w))), x -> x.w), '')").alias("w"))
    by_row = whole.groupBy("row").agg(F.expr("transform(sort_array(collect_list(struct(nth, w))), x -> x.w)").alias("written"))
    rebuilt = some.join(by_row, "row").withColumn("parts", F.expr(f"CASE WHEN mentions = '' THEN split(text, {_literal(ANY)}, -1) ELSE split(text, concat({_literal(ANY)}, mentions), -1) END"))
    rebuilt = rebuilt.select("doc_id", F.expr("array_join(zip_with(parts, written, (p, s) -> concat(p, coalesce(s, ''))), '')").alias("text"), "n_values")
    return rebuilt.unionByName(found.where("n_values <= 0").select("doc_id", "text", "n_values"))

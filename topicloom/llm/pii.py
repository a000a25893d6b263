"""Personal data replaced by keyed surrogates of the same type and format.

Entities are found by one pattern: e-mail addresses, announced, hexadecimal and prefixed secrets, IPv4 and
IPv6 addresses, phone numbers, bank accounts, social security numbers, card numbers, and names after a title. Every
mention is reduced to its entity (kind and canonical form), the entity's surrogate is drawn from a
keyed hash, and the surrogate takes the mention's format: separators, capitals, a valid check digit.
Names keep the gender of their title (if it has one) and their script, e-mail addresses the script of
their letters. An initial becomes an initial, so two initials may get the same letter; every other
entity has a surrogate of its own.

A surrogate depends on the entity, the key and a round only, so the same entity gets the same surrogate
in every document without any table of entities. Distinctness is checked over all entities: where two
entities draw the same surrogate, or one that is a real entity elsewhere, all but one draw again in the
next round until none collide. Only these exceptions are joined back to the texts that mention them.

Everything is DataFrame functions; texts move only if the exceptions are too many to send to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.functions.columns import let
from topicloom.llm.common import unused
from topicloom.plans.staging import lookup_join, stage

# Titles by the gender of the name that follows, "n" for those that do not tell; fixed values.
TITLES = {
    "f": "Mrs Ms Miss Madam Lady Frau Señora Señorita Sra Madame Mademoiselle Mme Mlle госпожа г-жа Κυρία κυρία".split(),
    "m": "Mr Sir Herr Señor Monsieur господин г-н Κύριος κύριος".split(),
    "n": "Dr Prof Professor Doctor Doktor Docteur Mx доктор Доктор д-р профессор Профессор проф Δρ".split(),
}
# Lower-case words inside a name, and abbreviated first names longer than a letter; fixed values.
PARTICLES = (
    "von vom van zu zur zum de del della dello delle dei degli di da do dos das du des la las lo los le el y e i"
    " bin ibn ben bint binti abu al ap af av te ten ter"
).split()
INITIALS = "Ph Th Ch Chr St Ste Wm Geo Дж".split()
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_END = r"(?![\p{L}\p{N}])"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]++\.)+\p{L}{2,}+" + _END
SECRET = r"(?:[0-9a-fA-F]{32,}+|(?:sk|pk|ghp|gho|xoxb|xoxp|AKIA)[-_]?[A-Za-z0-9_-]{16,}+)" + _END
IP = rf"(?<![0-9]\.){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?[0-9])" + _END
_HEX4 = "[0-9a-fA-F]{1,4}+"
IP6 = (
    rf"(?=[a-fA-F:]*+[0-9])(?:(?:{_HEX4}:){{7}}{_HEX4}|(?:{_HEX4}:){{2,6}}(?::{_HEX4}){{1,5}}"
    rf"|[0-9a-fA-F]{{3,4}}:(?::{_HEX4}){{1,6}})(?!:)" + _END
)
PHONE = (
    r"(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}"
    r"|\([0-9]{3}\) ?[0-9]{3}[-.][0-9]{4}|[0-9]{3}[-.][0-9]{3}[-.][0-9]{4})" + _END
)
IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _END
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _END
# Ungrouped numbers of 13 to 15 digits only as issuers begin them: moments in milliseconds and book numbers are no cards.
CARD = r"(?:4[0-9]{12}+|3[0689][0-9]{12}+|3[47][0-9]{13}+|(?:2131|1800)[0-9]{11}+|[0-9]{16,19}+|[0-9]{4}(?:[ -][0-9]{4}){2,3}(?:[ -][0-9]{1,4})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})" + _END
# A value after a word that says it is a credential; it must hold a digit. Only the value is replaced.
KEYED = r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\s{0,3}[:=]\s{0,3}[\"']?"
VALUE = r"(?=[\p{L}_+/.=~-]*+[0-9])[\p{L}\p{N}_+/.=~-]{6,}+"
# A title or a chain of them, as in "Frau Dr. med."; then any number of name words on one line.
_GAP = r"[\s\h]{1,3}"
_TITLE = "(?:" + "|".join(t for g in sorted(TITLES) for t in TITLES[g]) + ")"
TITLED = rf"(?:{_TITLE}(?:\.?-Ing)?\.?{_GAP}(?:\p{{Ll}}{{1,5}}\.[\s\h]{{0,3}})*+)++"
_WORD = r"\p{Lu}[\p{L}\p{M}'’-]*+"
# No name word is a title, an announced credential, or the beginning of an address or a number.
_OTHER = rf"(?!{_TITLE}\.?{_GAP}|{KEYED}|[\p{{L}}\p{{N}}._%+-]*+@)"
_LAST = rf"{_OTHER}(?:\p{{Ll}}{{1,3}}['’-]){{0,2}}+{_WORD}(?!\p{{N}})"
_INITIAL = rf"{_OTHER}(?:\p{{Lu}}|{'|'.join(INITIALS)})\.-?"
# "der" and its like are articles too and count only after a preposition
_PARTICLE = rf"(?:(?:von|van|zu|auf|op|in) (?:der|den|dem|het|de|['’]t)|{'|'.join(PARTICLES)}|['’]t)"
_NAME = rf"(?:(?:{_INITIAL}[\s\h]{{0,3}}|{_PARTICLE}{_GAP})*+{_LAST}|{_INITIAL}(?:\h{{0,3}}{_INITIAL})*+)"
NAME = rf"{TITLED}{_NAME}(?:\h{{1,3}}{_NAME})*+"
PII = rf"{EMAIL}|(?<![\p{{L}}\p{{N}}])(?:{KEYED}{VALUE}|{SECRET}|{IP6}|{IP}|{PHONE}|{IBAN}|{SSN}|{CARD}|{NAME})"
# A text without any of these holds no entity; cheap to test.
HINT = rf"[0-9@]|(?<![\p{{L}}\p{{N}}])(?:{_TITLE}(?:\.?-Ing)?\.?[\s\h]|{SECRET})"

# Letters by script for surrogates, and consonants and vowels for names; fixed values.
LETTERS = {
    "Cyrillic": "абвгдежзиклмнопрстуфхцчшэюя",
    "Greek": "αβγδεζηθικλμνξοπρστυφχψω",
    "Hebrew": "אבגדהוזחטיכלמנסעפצקרשת",
    "Arabic": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي",
    "Latin": "abcdefghijklmnopqrstuvwxyz",
}
SOUNDS = {
    "Cyrillic": ("бвгдзклмнпрст", "аеиоу", {"f": "а", "m": "в", "n": "о"}),
    "Greek": ("βγδζθκλμνπρστ", "αειου", {"f": "α", "m": "ς", "n": "ι"}),
    "Latin": ("bdfgklmnprstv", "aeiou", {"f": "a", "m": "n", "n": "i"}),
}


def _chars(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def _stream(key: str, kind: Column, canon: Column, turn: Column) -> Column:
    """Hexadecimal digits, four per character of the canonical form and 128 at least."""
    blocks = F.floor(F.length(canon) / 16) + 1
    return F.array_join(
        F.transform(
            F.sequence(F.lit(0), blocks.cast("int")),
            lambda i: F.sha2(F.concat_ws("|", F.lit(key), kind, turn.cast("string"), i.cast("string"), canon, F.lit(key)), 256),
        ),
        "",
    )


def _number(stream: Column, i: Column, digits: int = 4) -> Column:
    """The ``i``-th number of the stream, ``digits`` hexadecimal digits wide."""
    return F.conv(stream.substr((i * digits + 1).cast("int"), F.lit(digits)), 16, 10).cast("long")


def _pick(letters: str, number: Column) -> Column:
    return F.lit(letters).substr((number % len(letters) + 1).cast("int"), F.lit(1))


def _same_class(c: Column, number: Column) -> Column:
    """A character of the same class and script; marks stay. Letters of other scripts become Latin."""
    out = F.when(c.rlike("[0-9]"), _pick("0123456789", number))
    for script, letters in LETTERS.items():
        inside = c.rlike(r"\p{L}") if script == "Latin" else c.rlike(rf"[\p{{Is{script}}}&&\p{{L}}]")
        letter = _pick(letters, number)
        out = out.when(inside, F.when(c.rlike(r"\p{Lu}"), F.upper(letter)).otherwise(letter))
    return out.otherwise(c)


def _substituted(text: Column, stream: Column) -> Column:
    numbered = F.transform(_chars(text), lambda c, i: F.struct(c.alias("c"), _number(stream, i).alias("n")))
    return F.array_join(F.transform(numbered, lambda x: _same_class(x["c"], x["n"])), "")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Sum of the check-digit rule, from the right; valid when divisible by 10."""
    def weight(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.transform(_chars(F.reverse(digits)), weight), F.lit(0), lambda a, x: a + x)


def kind_of(mention: Column) -> Column:
    """Kind of a mention; names carry gender and script."""
    script = F.when(mention.rlike(r"\p{IsCyrillic}"), "Cyrillic").when(mention.rlike(r"\p{IsGreek}"), "Greek").otherwise("Latin")
    titles = F.regexp_extract(mention, f"^{TITLED}", 0)
    told = lambda g: titles.rlike(rf"(?<![\p{{L}}-])(?:{'|'.join(TITLES[g])})(?![\p{{L}}-])")
    gender = F.when(told("f"), "f ").when(told("m"), "m ").otherwise("n ")
    whole = lambda pattern: mention.rlike(f"^(?:{pattern})$")
    return (
        F.when(mention.rlike(f"^{KEYED}{VALUE}"), "keyed")
        .when(mention.contains("@"), "email")
        .when(whole(IP6), "ip6")
        .when(whole(IP), "ip")
        .when(whole(SSN), "ssn")
        .when(whole(PHONE), "phone")
        .when(whole(SECRET) & mention.rlike("^[0-9a-fA-F]+$"), "hex")
        .when(whole(CARD), "card")
        .when(whole(IBAN), "iban")
        .when(whole(SECRET), "secret")
        .otherwise(F.concat(F.lit("name "), gender, script))
    )


def canonical(kind: Column, mention: Column) -> Column:
    """What all mentions of one entity share. For a name, apply it to each of its words."""
    return (
        F.when(kind.isin("card", "ssn"), _digits(mention))
        .when(kind == "phone", F.concat(F.when(mention.startswith("+"), "+").otherwise(""), _digits(mention)))
        .when(kind == "iban", F.replace(mention, F.lit(" "), F.lit("")))
        .when(kind == "secret", mention)
        .otherwise(F.lower(mention))
    )


def _name(stream: Column, script: str, gender: str, more: Column) -> Column:
    """A lower-case name of three syllables (and ``more``) with the ending of its gender."""
    consonants, vowels, ends = SOUNDS[script]

    def syllable(i: Column) -> Column:
        return F.concat(_pick(consonants, _number(stream, 2 * i)), _pick(vowels, _number(stream, 2 * i + 1)))

    start = F.array_join(F.transform(F.sequence(F.lit(0), 2 + more), syllable), "")
    return F.concat(start, _pick(consonants, _number(stream, F.lit(20))), F.lit(ends[gender]))


def drawn(key: str, found: Column) -> Column:
    """Add ``drawn``, the canonical surrogate, to an array of structs with ``kind``, ``canon``, ``turn``.

    From turn 8 on, e-mail names, names and secrets grow and a short IPv6 address gets eight groups, so that a
    free draw is found where a format is used up. Structs without a kind
    pass through. Each step binds what the next one uses, so no expression is repeated.
    """
    with_stream = F.transform(
        found, lambda e: e.withField("s", F.when(e["kind"].isNotNull(), _stream(key, e["kind"], e["canon"], e["turn"])))
    )
    local = lambda e: F.when(e["kind"] == "email", F.substring_index(e["canon"], "@", 1)).otherwise(e["canon"])
    with_parts = F.transform(
        with_stream,
        lambda e: e.withField("sub", _substituted(local(e), e["s"])).withField(
            "ds",
            F.when(e["kind"] == "email", _stream(key, F.lit("domain"), F.substring_index(e["canon"], "@", -1), F.lit(0))),
        ),
    )

    # a first digit other than 0 stays other than 0
    def number(e: Column) -> Column:
        first = F.when(e["canon"].startswith("0"), e["sub"].substr(1, 1)).otherwise(_pick("123456789", _number(e["s"], F.lit(0))))
        return F.concat(first, e["sub"].substr(F.lit(2), F.length(e["sub"])))

    with_number = F.transform(with_parts, lambda e: e.withField("num", F.when(e["kind"].isin("phone", "card", "ssn"), number(e))))
    return F.transform(with_number, lambda e: e.withField("drawn", _by_kind(e)))


def _by_kind(e: Column) -> Column:
    kind, canon, s, ds, sub, num = (e[c] for c in ("kind", "canon", "s", "ds", "sub", "num"))
    more = F.greatest(F.lit(0), e["turn"] - 7).cast("int")
    extra = F.substr(F.translate(s, "0123456789", "ghijklmnop"), F.lit(1), more)
    name = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: _pick(LETTERS["Latin"], _number(ds, i))), "")
    top = F.element_at(F.array(F.lit("com"), F.lit("net"), F.lit("org")), (_number(ds, F.lit(6)) % 3 + 1).cast("int"))
    octet = [_number(s, F.lit(i)) for i in range(4)]
    ip = F.concat_ws(".", *[c.cast("string") for c in (octet[0] % 223 + 1, octet[1] % 256, octet[2] % 256, octet[3] % 254 + 1)])
    digits = F.translate(s, "abcdef", "012345")
    longer = F.substr(F.when(canon.rlike("^[0-9]+$"), digits).otherwise(s), F.lit(65), more)
    groups = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: s.substr((i * 4 + 1).cast("int"), F.lit(4))), ":")
    in_place = F.array_join(
        F.transform(_chars(canon), lambda c, i: F.when(c == ":", c).otherwise(s.substr((i * 4 + 1).cast("int"), F.lit(1)))), ""
    )
    body = num.substr(F.lit(1), F.length(num) - 1)
    check = ((10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10).cast("string")
    prefix = F.regexp_extract(canon, "^(?:sk|pk|ghp|gho|xoxb|xoxp|AKIA)[-_]?", 0)
    out = (
        F.when(kind == "email", F.concat(sub, extra, F.lit("@"), name, F.lit(".example."), top))
        .when(kind == "ip", ip)
        .when(kind == "phone", F.when(canon.startswith("+"), F.concat(canon.substr(1, 2), sub.substr(F.lit(3), F.length(sub)))).otherwise(num))
        .when(kind == "card", F.when(_luhn(canon) % 10 == 0, F.concat(body, check)).otherwise(num))
        .when(kind == "ssn", num)
        .when(kind == "iban", F.concat(canon.substr(1, 2), sub.substr(F.lit(3), F.length(sub))))
        .when(kind == "hex", F.concat(in_place, longer))
        .when(kind == "ip6", F.when(more > 0, groups).otherwise(in_place))
        .when(kind == "secret", F.concat(prefix, sub.substr(F.length(prefix) + 1, F.length(sub)), longer))
    )
    for script in SOUNDS:
        for gender in sorted(TITLES):
            out = out.when(kind == f"name {gender} {script}", _name(s, script, gender, more))
    return out


def _formatted(e: Column) -> Column:
    """The surrogate of a struct with ``raw``, ``kind`` and ``drawn`` in the format of ``raw``."""
    kind, raw, new = e["kind"], e["raw"], e["drawn"]
    digits = _digits(new)
    spread = F.array_join(
        F.transform(
            _chars(raw),
            lambda c, i: F.when(c.rlike("[0-9]"), digits.substr(F.length(_digits(raw.substr(F.lit(1), i))) + 1, F.lit(1))).otherwise(c),
        ),
        "",
    )
    spaced = F.array_join(
        F.transform(
            _chars(raw),
            lambda c, i: F.when(c == " ", c).otherwise(
                new.substr(F.length(F.replace(raw.substr(F.lit(1), i), F.lit(" "), F.lit(""))) + 1, F.lit(1))
            ),
        ),
        "",
    )
    # one letter, and another one than before: a drawn name begins with a consonant and a vowel
    first = F.when(new.substr(1, 1) == e["canon"], new.substr(2, 1)).otherwise(new.substr(1, 1))
    new = F.when(kind.startswith("name") & (F.length(raw) == 1), first).otherwise(new)
    letters = F.regexp_replace(raw, r"[^\p{L}]", "")
    cased = (
        F.when((F.length(letters) > 1) & (letters == F.upper(letters)) & (letters != F.lower(letters)), F.upper(new))
        .when(raw.rlike(r"^\p{Lu}"), F.concat(F.upper(new.substr(1, 1)), new.substr(F.lit(2), F.length(new))))
        .otherwise(new)
    )
    return (
        F.when(kind.isNull(), raw)
        .when(kind.isin("phone", "card", "ssn"), spread)
        .when(kind == "iban", spaced)
        .when(kind.isin("ip", "secret"), new)
        .otherwise(cased)
    )


def mentions(text: Column) -> Column:
    """All mentions in a text, in order; none for a null text."""
    none = F.array().cast("array<string>")
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PII), F.lit(0))).otherwise(none)


def pieces(found: Column) -> Column:
    """``array<struct<at, raw, kind, canon>>`` of an array of mentions.

    ``at`` is the mention's number. A name is cut into its titles, separators with particles, and words, a
    credential into what announces it and its value; only words and values have a kind. Any other mention
    is one piece.
    """
    kinds = F.transform(found, lambda m, i: F.struct(i.alias("at"), m.alias("m"), kind_of(m).alias("kind")))

    def cut(e: Column) -> Column:
        titles = F.regexp_extract(e["m"], f"^{TITLED}", 0)
        rest = e["m"].substr(F.length(titles) + 1, F.length(e["m"]))
        parts = F.concat(F.array(titles), F.regexp_extract_all(rest, F.lit(rf"{_WORD}|[^\p{{Lu}}]++"), F.lit(0)))
        named = F.transform(
            parts,
            lambda w, j: F.struct(
                e["at"].alias("at"), w.alias("raw"), F.when((j > 0) & w.rlike(r"^\p{Lu}"), e["kind"]).alias("kind")
            ),
        )
        start = F.regexp_extract(e["m"], f"^{KEYED}", 0)
        value = e["m"].substr(F.length(start) + 1, F.length(e["m"]))
        mixed = value.rlike("^(?=.*[a-fA-F])(?=.*[0-9])[0-9a-fA-F]+$")
        keyed = F.array(
            F.struct(e["at"].alias("at"), start.alias("raw"), F.lit(None).cast("string").alias("kind")),
            F.struct(e["at"].alias("at"), value.alias("raw"), F.when(mixed, "hex").otherwise("secret").alias("kind")),
        )
        return F.when(e["kind"].startswith("name"), named).when(e["kind"] == "keyed", keyed).otherwise(
            F.array(F.struct(e["at"].alias("at"), e["m"].alias("raw"), e["kind"].alias("kind")))
        )

    return F.transform(
        F.flatten(F.transform(kinds, cut)), lambda p: p.withField("canon", canonical(p["kind"], p["raw"]))
    )


def entities_in(text: Column) -> Column:
    """Distinct ``struct<kind, canon>`` of the entities a text mentions."""
    known = F.filter(pieces(mentions(text)), lambda p: p["kind"].isNotNull())
    return F.array_distinct(F.transform(known, lambda p: F.struct(p["kind"].alias("kind"), p["canon"].alias("canon"))))


def late_entities(docs: DataFrame, key: str) -> DataFrame:
    """``(kind, canon, turn)`` of the entities whose first draw collides, with the round that does not.

    A draw is taken by the smallest entity that makes it, if no other entity has taken it and no entity
    is called that.
    """
    found = docs.select(F.explode(entities_in(F.col("text"))).alias("e"))
    everyone = stage(found.select("e.kind", "e.canon").distinct(), "pii-entities")
    pending, taken, late, turn = everyone, None, None, 0
    while True:
        one = F.array(F.struct("kind", "canon", F.lit(turn).alias("turn")))
        draws = pending.select("kind", "canon", F.explode(drawn(key, one)).alias("e"))
        draws = draws.select("kind", "canon", F.col("e.drawn").alias("drawn"))
        best = draws.groupBy("kind", "drawn").agg(F.min("canon").alias("canon"))
        real = everyone.select("kind", F.col("canon").alias("drawn"))
        best = best.join(real, ["kind", "drawn"], "left_anti")
        if taken is not None:
            best = best.join(taken, ["kind", "drawn"], "left_anti")
        best = stage(best, "pii-drawn")
        if turn:
            now = best.select("kind", "canon", F.lit(turn).alias("turn"))
            late = now if late is None else late.union(now)
        taken = best.select("kind", "drawn") if taken is None else taken.union(best.select("kind", "drawn"))
        pending = stage(pending.join(best.select("kind", "canon"), ["kind", "canon"], "left_anti"), "pii-pending")
        turn += 1
        if pending.isEmpty():
            break
        if turn > 200:
            raise RuntimeError("a kind of entity has more members than its format has values")
    if late is None:
        late = everyone.select("kind", "canon", F.lit(0).alias("turn")).limit(0)
    return late


def _name_words(done: Column) -> Column:
    """``array<struct<raw, new>>``: the words of titled names, initials aside, each with its first surrogate."""
    words = F.filter(done, lambda e: e["kind"].startswith("name") & (F.length(e["raw"]) > 1))
    ordered = F.sort_array(F.transform(words, lambda e, i: F.struct(e["raw"].alias("raw"), i.alias("i"), e["new"].alias("new"))))
    # sorted, the first of equal words follows another word; a search for each word would take the square of their number
    first = let(ordered, lambda o: F.filter(o, lambda e, j: (j == 0) | (F.get(o, j - 1)["raw"] != e["raw"])))
    placed = F.sort_array(F.transform(first, lambda e: F.struct(e["i"].alias("i"), e["raw"].alias("raw"), e["new"].alias("new"))))
    return F.transform(placed, lambda e: F.struct(e["raw"].alias("raw"), e["new"].alias("new")))


def _renamed(text: Column, words: Column) -> Column:
    """The text with every whole word of ``words`` replaced; words hold letters, apostrophes and hyphens only."""
    edge = r"[\p{L}\p{N}]"
    return F.aggregate(
        words, text, lambda b, w: F.regexp_replace(b, F.concat(F.lit(rf"(?<!{edge})"), w["raw"], F.lit(rf"(?!{edge})")), w["new"])
    )


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """The documents with every entity in ``text`` replaced, all other columns as they are.

    A null text stays null, an empty one empty, a text without entities is unchanged. Equal texts get
    equal results wherever they are; ids play no part, so null, repeated or missing ones do not matter.
    A name's words are also replaced where the text repeats them without a title, in the same spelling; where two
    titled names of a text share a word, such a repeat gets the surrogate of the first. Added is ``n_entities``, the
    number of mentions replaced, repeats without a title not counted; a column of that name is overwritten.
    """
    names = docs.columns
    added = ("_found", "_mark", "_late", "_turns", "_new", "_names")
    found, mark, lates, turns_, pieced, named = (unused(names, c) for c in added)
    late = stage(late_entities(docs, key), "pii-late")
    text = F.col("text")
    rows = docs.withColumn(found, mentions(text))
    if late.isEmpty():
        turn = lambda p: F.lit(0)
    else:
        told = docs.select(F.md5("text").alias(mark), F.explode(entities_in(text)).alias("e"))
        told = lookup_join(
            told.select(mark, F.concat_ws("|", "e.kind", "e.canon").alias("entity")),
            late.select(F.concat_ws("|", "kind", "canon").alias("entity"), "turn"),
            "entity", spread_by=mark,
        ).distinct()
        turns = told.groupBy(mark).agg(
            F.collect_list("entity").alias(lates), F.collect_list("turn").alias(turns_)
        )
        # entity and turn lists keep their order: both come from the same rows of one aggregation
        rows = lookup_join(
            rows.withColumn(mark, F.md5("text")), stage(turns, "pii-turns"), mark, "left", spread_by=found
        )

        def turn(p: Column) -> Column:
            at = F.array_position(lates, F.concat_ws("|", p["kind"], p["canon"]))
            return F.coalesce(F.try_element_at(turns_, F.nullif(at.cast("int"), F.lit(0))), F.lit(0))

    cut = F.transform(pieces(F.col(found)), lambda p: p.withField("turn", turn(p)))
    done = F.transform(
        drawn(key, cut),
        lambda e: F.struct(e["at"].alias("at"), e["raw"].alias("raw"), e["kind"].alias("kind"), _formatted(e).alias("new")),
    )
    rows = rows.withColumn(pieced, F.when(F.size(found) > 0, done))
    rows = rows.withColumn(named, _name_words(F.col(pieced)))
    # the text between mentions, each followed by what replaces the mention
    joined = F.transform(
        F.split(text, PII, -1),
        lambda b, i: F.concat(
            F.when(F.size(named) > 0, _renamed(b, F.col(named))).otherwise(b), F.array_join(F.transform(F.filter(pieced, lambda e: e["at"] == i), lambda e: e["new"]), "")
        ),
    )
    new = F.when(F.size(found) > 0, F.array_join(joined, "")).otherwise(text)
    return rows.select(
        *[new.alias("text") if c == "text" else F.col(f"`{c}`") for c in names if c.lower() != "n_entities"],
        F.size(found).alias("n_entities"),
    )

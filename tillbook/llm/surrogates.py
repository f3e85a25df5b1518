"""Personal data replaced by keyed surrogates of the same type, script, gender and format.

All of it is Column expressions. One pattern finds the entities of a text; the text is split at them and joined again
around their surrogates. A person is found by a title; the names of a text's titled persons are exchanged wherever else
they stand in that text, as whole words in the same spelling. A person without a title in the whole text is not found. A surrogate is a keyed hash of the entity's canonical form (so the same entity reads the same
everywhere, whatever its spelling), its type and an attempt number. The table of distinct entities is checked: where
two entities of a type would get one surrogate, or a surrogate is itself an entity of the corpus, the later ones go on
to their next attempt, until nothing collides. A given name has one key whatever the title; only its ending follows the
gender that the text's titles tell, once for all mentions in that text.

Patterns repeat groups a bounded number of times or possessively, so no text is too long for them: up to 8 titles and 16
name words make a person, a local part has up to 256 signs and a domain up to 127 labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tillbook.functions.let import cases, let
from tillbook.llm.common import unused
from tillbook.session import stored

KEY = "surrogates"
# The attempt from which on surrogates of digits and letters grow longer.
GROWS = 8

_MALE = "Mr|Herr|Herrn|Monsieur|Señor|Sr|Don|г-н|господин"
_FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Señorita|Sra|Doña|г-жа|госпожа"
_NEUTRAL = "Dr|Prof"
# Name words (O'Brien, Jean-Luc; without the ending of a possessive), initials, and what may stand between name words.
_NAME = r"\p{Lu}(?:['’]\p{Lu})?\p{Ll}(?:\p{L}|['’-](?=\p{L})(?!s(?!\p{L})))*+"
_INITIAL = r"\p{Lu}\.(?:[ -]?\p{Lu}\.)*+|\p{Lu}(?=[ ]\p{Lu}\p{Ll})"
_PARTICLE = "von|vom|van|zu|zum|zur|de|del|della|der|den|di|da|dal|do|dos|das|du|la|le|el|al|bin|ibn|ter|ten|af|av|y|e|фон"
_BETWEEN = rf"(?:(?:{_INITIAL}|(?:{_PARTICLE})(?=[ ]))[ ])*+"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_END = r"(?![\p{L}\p{N}])"

# Each kind with the pattern of its entities, in the order in which they are tried where a word begins.
KINDS: dict[str, str] = {
    "email": r"[\p{L}\p{N}._%+\-]{1,256}+@(?:[\p{L}\p{N}\-]++\.){1,126}\p{L}{2,}",
    "secret": r"(?:(?=[A-Fa-f]*\d)[0-9a-f]{32,}|(?=[A-Fa-f]*\d)[0-9A-F]{32,}|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,}"
    + r"|sk-[0-9A-Za-z_\-]{20,}|xox[baprs]-[0-9A-Za-z\-]{10,}|eyJ[0-9A-Za-z_\-]{10,}\.[0-9A-Za-z_\-]{10,}\.[0-9A-Za-z_\-]{10,})"
    + _END,
    "iban": r"[A-Z]{2}\d{2}(?:[ ]?(?=[A-Z]*\d)[A-Z0-9]{4}){3,7}(?:[ ]?[0-9]{1,3})?" + _END,
    "mac": r"(?<![:-])[0-9A-Fa-f]{2}(?<m>[:-])[0-9A-Fa-f]{2}(?:\k<m>[0-9A-Fa-f]{2}){4}(?![\p{L}\p{N}:-])",
    # The compressed form needs a digit and a group of three signs: ::1 and 1::2 are loopbacks and slices, ab::cd a name.
    "ipv6": r"(?<!:)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[A-Fa-f:]*\d)(?=[0-9A-Fa-f:]*?[0-9A-Fa-f]{3})(?!(?:[0-9A-Fa-f:]*[0-9A-Fa-f])?::[0-9A-Fa-f:]*::)"
    + r"(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![\p{L}\p{N}:]|\.\d)",
    "ip": rf"(?<!\.){_OCTET}(?:\.{_OCTET}){{3}}" + r"(?![\p{L}\p{N}]|\.\d)",
    "social": r"(?<!-)\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])",
    "phone": r"(?<!\+)(?:(?:\+1[ .-]?|1[ .-])?(?:\(\d{3}\)[ .-]?|\d{3}[.-])\d{3}[ .-]\d{4}(?![\p{L}\p{N}-])"
    + r"|\+1[ .-]?\d{3}[ .-]?\d{3}[ .-]?\d{4}(?![\p{L}\p{N}-])"
    + r"|\+[2-9]\d{0,2}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{2,4}){2,5}(?![\p{L}\p{N}]|[.-]\d))",
    "card": r"(?<![.-])(?:\d{13,19}|\d{4}(?<c>[ -])\d{4}\k<c>\d{4}\k<c>\d{1,7}|3\d{3}(?<d>[ -])\d{6}\k<d>\d{5})"
    + r"(?![\p{L}\p{N}]|[.-]\d)",
    "person": rf"(?:(?:{_MALE}|{_FEMALE}|{_NEUTRAL})\.?[ ]){{1,8}}{_BETWEEN}{_NAME}(?:[ ]{_BETWEEN}{_NAME}){{0,15}}",
}
# What may begin inside a word is ruled out once for all kinds; kinds that begin with a digit or sign are tried there only.
_SIGNED = ("ip", "social", "phone", "card")
PATTERN = (
    r"(?<![\p{L}\p{N}])(?:"
    + "|".join(p for k, p in KINDS.items() if k not in _SIGNED and k != "person")
    + r"|(?=[0-9+(])(?:"
    + "|".join(KINDS[k] for k in _SIGNED)
    + r")|(?=\p{L})"
    + KINDS["person"]
    + ")"
)
# A text with none of these has no entity, which is found out faster than by the pattern.
_HINTS = (
    "Mr Ms Miss Herr Frau Monsieur Madame Mme Mlle Señor Sr Don Doña Dr Prof г-н г-жа господин госпожа AKIA ghp_ gho_ "
    "ghu_ ghs_ ghr_ sk- xox eyJ"
).split()
_MALE_TITLE = rf"^(?:{_MALE})\.?[ ]"
_FEMALE_TITLE = rf"^(?:{_FEMALE})\.?[ ]"
_TITLE = rf"^(?:(?:{_MALE}|{_FEMALE}|{_NEUTRAL})\.?[ ]){{1,8}}"

# Sounds that surrogate names are made of, sixteen for each script.
SYLLABLES = {
    "latin": "ba de fi ga ho ju ka le mi no pa re sa to vi za".split(),
    "cyrillic": "ба ве ги да жо зу ка ле ми но па ре са то ви за".split(),
    "greek": "βα γε δι ζο θα κα λε μι νο πα ρε σα το φι χα ξε".split(),
}
# Endings by gender: four of each, for given names; family names take the neutral ones.
ENDINGS = {
    "latin": {"m": "n r s l".split(), "f": "a na ra la".split(), "n": "er en is ol".split()},
    "cyrillic": {"m": "н р с л".split(), "f": "а на ра ла".split(), "n": "ер ен ис ол".split()},
    "greek": {"m": "ος ης ας ων".split(), "f": "α η ια να".split(), "n": "ερ εν ισ ολ".split()},
}


def entities_of(text: Column) -> Column:
    """The entities of a text in their order; null for a null text."""
    hinted = text.rlike("[0-9@]|[A-Fa-f]{1,4}[:-][A-Fa-f]{1,4}[:-]")
    for hint in _HINTS:
        hinted = hinted | F.contains(text, F.lit(hint))
    return F.when(hinted, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).when(
        text.isNotNull(), F.array().cast("array<string>")
    )


def kind_of(value: Column) -> Column:
    """The kind of a found entity: the first whose pattern is all of it."""
    branches = [(value.rlike(f"^(?:{pattern})$"), F.lit(kind)) for kind, pattern in KINDS.items()]
    return cases(*branches, otherwise=F.lit("card"))


def _script(token: Column) -> Column:
    return cases(
        (token.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")), (token.rlike(r"\p{IsGreek}"), F.lit("greek")),
        otherwise=F.lit("latin"),
    )


def _gender(value: Column) -> Column:
    """What a person's first title says: m, f or n."""
    return cases((value.rlike(_MALE_TITLE), F.lit("m")), (value.rlike(_FEMALE_TITLE), F.lit("f")), otherwise=F.lit("n"))


def _given_names(value: Column) -> Column:
    names = F.filter(_name_words(value), _is_name)
    return let(names, lambda n: F.slice(n, F.lit(1), F.greatest(F.lit(0), F.size(n) - 1)))


def _genders(titled: Column) -> Column:
    """array<struct<name, gender>>: the given names of a text's titled persons whose title tells a gender, in their order."""
    told = F.filter(titled, lambda v: _gender(v) != "n")
    named = lambda v: F.transform(_given_names(v), lambda w: F.struct(w.alias("name"), _gender(v).alias("gender")))
    return F.array_distinct(F.flatten(F.transform(told, named)))


def _is_name(token: Column) -> Column:
    return token.rlike(f"^(?:{_NAME})$")


def _name_words(value: Column) -> Column:
    """The words after a person's titles: names, initials and particles."""
    return F.split(F.regexp_replace(value, _TITLE, ""), " ")


def parts_of(value: Column) -> Column:
    """array<struct<kind, canon>>: what must keep apart and together. A person is given names, or none, and a family name."""
    digits = F.regexp_replace(value, r"[^0-9]", "")

    def person(tokens: Column) -> Column:
        return F.transform(
            tokens,
            lambda token, i: F.struct(
                F.concat(
                    F.when(i < F.size(tokens) - 1, F.lit("given-")).otherwise(F.lit("family-")), _script(token)
                ).alias("kind"),
                F.lower(token).alias("canon"),
            ),
        )

    def plain(kind: Column) -> Column:
        canon = cases(
            (kind == "phone", F.when(value.startswith("+"), F.concat(F.lit("+"), digits)).otherwise(digits)),
            (kind.isin("card", "social"), digits),
            (kind == "iban", F.regexp_replace(value, " ", "")),
            (kind == "secret", value),
            otherwise=F.lower(value),
        )
        return F.array(F.struct(kind.alias("kind"), canon.alias("canon")))

    names = F.filter(_name_words(value), _is_name)
    return let(
        kind_of(value),
        lambda kind: F.when(kind == "person", let(names, person)).otherwise(plain(kind)),
    )


def _hash(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """64 hexadecimal digits."""
    return F.sha2(F.concat_ws("\u0001", F.lit(key), kind, attempt.cast("string"), canon), 256)


def _digits(h: Column) -> Column:
    """64 decimal digits of a hash."""
    return F.concat(
        *[F.right(F.lpad(F.conv(F.substring(h, at, 15), 16, 10), 19, "0"), F.lit(16)) for at in (1, 16, 31, 46)]
    )


def _at(stream: Column, i: Column) -> Column:
    return F.substring(stream, F.pmod(i, F.lit(64)) + 1, F.lit(1))


def _letters(h: Column) -> Column:
    return F.translate(h, "0123456789abcdef", "abcdefghijklmnop")


def _same_format(value: Column, h: Column, kept: Column) -> Column:
    """``value`` with every digit and letter exchanged, apart from the first ``kept`` digits or letters of it.

    Digits are taken by how many digits stand before them, so that other separators change nothing.
    """
    digits, letters = _digits(h), _letters(h)

    def one(c: Column, i: Column) -> Column:
        before = F.length(F.regexp_replace(F.substring(value, F.lit(1), i), r"[^0-9A-Za-z]", ""))
        return cases(
            (before < kept, c),
            (c.rlike("[0-9]"), _at(digits, before)),
            (c.rlike("[a-z]"), _at(letters, before)),
            (c.rlike("[A-Z]"), F.upper(_at(letters, before))),
            otherwise=c,
        )

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _hexadecimal(value: Column, h: Column) -> Column:
    """Hexadecimal digits for hexadecimal digits, in the same case; other signs stay."""

    def one(c: Column, i: Column) -> Column:
        return cases(
            (c.rlike("[0-9a-f]"), _at(h, i)), (c.rlike("[A-F]"), F.upper(_at(h, i))), otherwise=c
        )

    made = F.array_join(F.transform(F.split(value, ""), one), "")
    return F.when(value == F.upper(value), F.upper(made)).otherwise(made)


def _number(h: Column, at: int, below: int) -> Column:
    return F.conv(F.substring(h, at, 6), 16, 10).cast("int") % below


def _name(kind: Column, h: Column, attempt: Column, gender: Column) -> Column:
    """A name of three syllables and one more for each attempt, with an ending of its gender.

    Names of other syllables are other names whatever their endings, which are one or two letters.
    """
    options = []
    for script, sounds in SYLLABLES.items():
        for of_gender, endings in ENDINGS[script].items():
            syllables = F.array(*[F.lit(s) for s in sounds])
            said = F.transform(
                F.sequence(F.lit(1), F.least(F.lit(60), attempt + 3)),
                lambda i: F.element_at(syllables, F.conv(F.substring(h, i, F.lit(1)), 16, 10).cast("int") + 1),
            )
            ending = F.element_at(F.array(*[F.lit(e) for e in endings]), _number(h, 58, 4) + 1)
            options.append((kind.endswith(f"-{script}") & (gender == of_gender), F.initcap(F.concat(F.array_join(said, ""), ending))))
    return cases(*options)


def surrogate(
    kind: Column, canon: Column, spelling: Column, attempt: Column, key: str = KEY, gender: Column | None = None
) -> Column:
    """What stands for an entity, in the format of ``spelling``; names get the ending of ``gender`` (m, f, or n: neutral).

    From attempt ``GROWS`` on, what is made of digits and letters gets one more digit at its end with each attempt, so
    that no format runs out of values, and IPv6 addresses get all eight groups; other addresses have 3.7 billion values.
    """
    more = F.greatest(F.lit(0), F.least(F.lit(40), attempt - (GROWS - 1)))

    def longer(made: Column, h: Column) -> Column:
        return F.concat(made, F.substring(F.reverse(_digits(h)), F.lit(1), more))

    def email(h: Column) -> Column:
        domain = F.substring_index(F.lower(spelling), "@", -1)
        label = F.substring(_letters(_hash(F.lit("domain"), domain, F.lit(0), key)), 1, 8)
        local = F.concat(F.substring(_letters(h), 1, 10), F.regexp_extract(spelling, r"([._+\-]\d+)@", 1))
        address = F.concat(
            F.when(F.length(F.regexp_extract(spelling, r"[._+\-](\d+)@", 1)) > 0,
                   F.concat(F.substring(_letters(h), 1, 10), F.lit("."), F.substring(_digits(h), 1, 2))).otherwise(local),
            F.lit("@"), label, F.lit(".example."), F.substring_index(domain, ".", -1),
        )
        return F.when(spelling == F.upper(spelling), F.upper(address)).otherwise(address)

    def made(h: Column) -> Column:
        octets = [_number(h, 1, 223) + 1, _number(h, 7, 256), _number(h, 13, 256), _number(h, 19, 254) + 1]
        country = F.length(F.regexp_extract(spelling, r"^\+(1|\d{2})", 1))
        return cases(
            (kind == "email", email(h)),
            (kind == "ip", F.concat_ws(".", *[o.cast("string") for o in octets])),
            ((kind == "ipv6") & (attempt >= GROWS), F.concat_ws(":", *[F.substring(h, at, 4) for at in range(1, 33, 4)])),
            (kind.isin("mac", "ipv6"), _hexadecimal(spelling, h)),
            (kind == "secret", longer(F.when(spelling.rlike("^[0-9A-Fa-f]+$"), _hexadecimal(spelling, h)).otherwise(
                _same_format(spelling, h, F.lit(3))), h)),
            (kind == "phone", longer(_same_format(spelling, h, country), h)),
            (kind == "iban", longer(_same_format(spelling, h, F.lit(2)), h)),
            (kind.isin("card", "social"), longer(_same_format(spelling, h, F.lit(0)), h)),
            otherwise=_name(kind, h, attempt, F.lit("n") if gender is None else gender),
        )

    return let(_hash(kind, canon, attempt, key), made)


def _canonical_surrogate(key: str, gender: str = "n") -> Column:
    return F.lower(surrogate(F.col("kind"), F.col("canon"), F.col("canon"), F.col("attempt"), key, F.lit(gender)))


def distinct_entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """(kind, canon) of every entity of the corpus, once."""
    found = docs.select(F.explode(entities_of(F.col(text))).alias("value"))
    return found.select(F.explode(parts_of(F.col("value"))).alias("part")).select("part.kind", "part.canon").distinct()


def settle(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, canon, attempt): attempts under which no two entities of a kind share a surrogate and none is an entity.

    Of entities that collide the one with the smallest canonical form keeps its attempt. Every round works on the whole
    entity table, one row per entity; only whether anything still collides reaches the driver.
    """
    held = stored(entities.withColumn("attempt", F.lit(0)), "entities")
    while True:
        forms = F.when(F.col("kind").startswith("given-"), F.array(*[_canonical_surrogate(key, g) for g in "mfn"]))
        made = stored(held.withColumns({"made": _canonical_surrogate(key), "forms": forms}), "made")
        first = made.groupBy("kind", "made").agg(F.min("canon").alias("first"), F.count("*").alias("n")).filter("n > 1")
        later = made.join(first, ["kind", "made"]).filter("canon <> first").select("kind", "canon")
        real = made.select("kind", "canon", F.explode(F.coalesce("forms", F.array("made"))).alias("form")).join(
            held.select("kind", F.lower("canon").alias("form")).distinct(), ["kind", "form"], "left_semi"
        )
        losers = stored(
            later.unionByName(real.select("kind", "canon")).distinct().withColumn("again", F.lit(1)), "colliding"
        )
        if losers.isEmpty():
            return held
        held = stored(
            held.join(losers, ["kind", "canon"], "left").select(
                "kind", "canon", (F.col("attempt") + F.coalesce(F.col("again"), F.lit(0))).alias("attempt")
            ),
            "entities",
        )


def _attempt(part: Column, later: Column) -> Column:
    return F.coalesce(F.element_at(later, F.concat_ws("\u0001", part["kind"], part["canon"])), F.lit(0))


def _names_of(value: Column, genders: Column, later: Column, key: str) -> Column:
    """array<struct<name, made>>: the name words of an entity with their surrogates, spelled so and in capitals alone;
    empty if it is no person."""

    def named(parts: Column) -> Column:
        words = F.filter(_name_words(value), _is_name)

        def one(w: Column, p: Column) -> Column:
            told = F.coalesce(F.get(F.filter(genders, lambda g: g["name"] == w), F.lit(0))["gender"], F.lit("n"))
            gender = F.when(p["kind"].startswith("given-"), told).otherwise(F.lit("n"))
            return F.struct(w.alias("name"), surrogate(p["kind"], p["canon"], p["canon"], _attempt(p, later), key, gender).alias("made"))

        return let(
            F.zip_with(words, parts, one),
            lambda plain: F.concat(
                plain, F.transform(plain, lambda n: F.struct(F.upper(n["name"]).alias("name"), F.upper(n["made"]).alias("made")))
            ),
        )

    nothing = F.array().cast("array<struct<name:string,made:string>>")
    return F.when(value.rlike(_TITLE), let(parts_of(value), named)).otherwise(nothing)


def _replaced(value: Column, names: Column, later: Column, key: str) -> Column:
    """An entity's surrogate in its own spelling; ``names`` are those of its text's persons with their surrogates, and
    ``later`` maps kind and canonical form to attempts beyond the first."""

    def person(named: Column) -> Column:
        """Names by their surrogates, initials by other ones, particles as they are."""
        made = F.transform(
            _name_words(value),
            lambda w: F.when(_is_name(w), F.element_at(
                F.filter(named, lambda n: n["name"] == w), 1)["made"]
            ).when(w.rlike(r"^\p{Lu}(?:\.|$)"), F.regexp_replace(
                w, r"\p{Lu}", F.upper(F.substring(_letters(_hash(F.lit("initial"), w, F.lit(0), key)), 1, 1))
            )).otherwise(w),
        )
        return F.concat(F.regexp_extract(value, _TITLE, 0), F.array_join(made, " "))

    def whole(parts: Column) -> Column:
        return surrogate(parts[0]["kind"], parts[0]["canon"], value, _attempt(parts[0], later), key)

    return F.when(value.rlike(_TITLE), person(names)).otherwise(let(parts_of(value), whole))


def _mentions(names: Column) -> Column:
    """The pattern of a text's names as whole words, longer ones first."""
    ordered = F.reverse(F.array_sort(F.array_distinct(F.transform(names, lambda n: n["name"]))))
    return F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(ordered, "|"), F.lit(r")(?![\p{L}\p{N}])"))


def _renamed(piece: Column, names: Column, pattern: Column) -> Column:
    """``piece`` with every mention of one of the ``names`` exchanged."""
    made = F.transform(
        F.regexp_extract_all(piece, pattern, F.lit(0)),
        lambda m: F.element_at(F.filter(names, lambda n: n["name"] == m), 1)["made"],
    )
    gaps = F.split(piece, pattern, -1)
    return F.array_join(F.zip_with(gaps, F.concat(made, F.array(F.lit(""))), lambda gap, m: F.concat(gap, m)), "")


def replace_entities(docs: DataFrame, text: str = "text", key: str = KEY, count: str | None = None) -> DataFrame:
    """``docs`` with every entity of ``text`` exchanged; other columns stay, and ``count`` gets the number of entities.

    Untitled mentions of the persons that a text names with their title are exchanged and counted, too, if they are
    spelled alike or in capitals. Null stays null (count 0); texts without entities, empty ones too, stay as they are.
    Equal texts stay equal, repeated rows stay as many. Texts of any length are read whole. Working columns get names
    that clash with none of ``docs``. An empty table gives an empty one.
    """
    attempts = settle(distinct_entities(docs, text), key).filter(F.col("attempt") > 0)
    names = unused(docs, "found", "later", "text_key", "text_key2", "genders", "named", "mentions")
    found, later, k1, k2, genders, named, mentions = (F.col(n) for n in names.values())
    body = docs.withColumn(names["found"], entities_of(F.col(text)))
    nothing = F.lit(None).cast("map<string,int>")
    if attempts.isEmpty():
        body = body.withColumn(names["later"], nothing)
    else:
        body = body.withColumns({names["text_key"]: F.xxhash64(text), names["text_key2"]: F.xxhash64(F.lit(key), text)})
        parts = (
            body.filter(F.size(found) > 0)
            .select(k1, k2, F.explode(F.array_distinct(F.flatten(F.transform(found, parts_of)))).alias("part"))
            .select(k1, k2, "part.kind", "part.canon").distinct()
        )
        own = (
            parts.join(attempts, ["kind", "canon"])
            .groupBy(k1, k2)
            .agg(
                F.map_from_entries(
                    F.collect_set(F.struct(F.concat_ws("\u0001", "kind", "canon").alias("key"), F.col("attempt").alias("value")))
                ).alias(names["later"])
            )
        )
        body = body.join(own, [names["text_key"], names["text_key2"]], "left")
    titled = F.filter(F.array_distinct(found), lambda v: v.rlike(_TITLE))
    body = body.withColumn(names["genders"], F.when(F.size(titled) > 0, _genders(titled))).withColumn(
        names["named"],
        F.when(F.size(titled) > 0, F.array_distinct(F.flatten(F.transform(titled, lambda v: _names_of(v, genders, later, key))))),
    ).withColumn(names["mentions"], F.when(named.isNotNull(), _mentions(named)))
    plain = F.split(F.col(text), PATTERN, -1)
    pieces = F.when(mentions.isNull(), plain).otherwise(F.transform(plain, lambda piece: _renamed(piece, named, mentions)))
    made = F.concat(F.transform(found, lambda v: _replaced(v, named, later, key)), F.array(F.lit("")))
    new = F.when(
        F.size(found) > 0, F.array_join(F.zip_with(pieces, made, lambda piece, s: F.concat(piece, s)), "")
    ).otherwise(F.col(text))
    columns = [new.alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns if c != count]
    if count:
        untitled = F.when(mentions.isNotNull(), F.aggregate(
            plain, F.lit(0), lambda n, piece: n + F.size(F.regexp_extract_all(piece, mentions, F.lit(0)))))
        entities = F.coalesce(F.size(found), F.lit(0)) + F.coalesce(untitled, F.lit(0))
        columns.append(F.greatest(F.lit(0), entities).alias(count))
    return body.select(*columns)

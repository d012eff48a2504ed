"""Inverse normalisation of spoken English numbers, inside the JVM.

Each token becomes one symbol for its kind, and the grammar of written forms is one
regular expression over the symbols of a run: the longest form wins at each place,
and a form is never a part of a longer run of number words.  Its value is a fold over
the few words of a match.  Only runs of words of the grammar are looked at; a text
without a number word costs one test.

Forms: cardinals (one hundred and five: 105), decimals (three point one four: 3.14),
ordinals from tenth on (twenty first: 21st), percent (2.5%), money ($25, $5.20, $0.99,
€1200, $2.5 million), dates (march fifth twenty twenty five: march 5 2025; the fifth of
march: 5 march) and times (two thirty pm: 02:30 p.m.; half past seven: 07:30; eight
o'clock: 08:00).  Ordinals below ten alone stay words, as "second" and "first" often are
no numbers.  Runs of number words that are no number (one two three) stay as they are.
A mark after a word ends a form and is kept.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.functions.lexicon import TENS, UNITS
from parlance.functions.text import col, let, pieces

ORDINAL_UNITS = ("zeroth", "first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "eleventh", "twelfth", "thirteenth", "fourteenth", "fifteenth", "sixteenth", "seventeenth", "eighteenth", "nineteenth")
ORDINAL_TENS = ("twentieth", "thirtieth", "fortieth", "fiftieth", "sixtieth", "seventieth", "eightieth", "ninetieth")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
SIGNS = {"dollar": "$", "dollars": "$", "euro": "€", "euros": "€", "pound": "£", "pounds": "£"}
SCALES = {"thousand": ("K", 10**3), "million": ("M", 10**6), "billion": ("B", 10**9)}

#: Word to (symbol, value).  Symbols: z zero, e one, u 2-9, l 10-12, t 13-19, w 20, x 30, v 40 and 50, y 60-90, h hundred,
#: K M B scales; f first, o other ordinals below ten, L T W X Y H k their like above; the rest stand for single words.
WORDS: dict[str, tuple[str, int]] = {w: ("z" if not i else "e" if i == 1 else "u" if i < 10 else "l" if i < 13 else "t", i) for i, w in enumerate(UNITS)}
WORDS |= {w: ("wxvvyyyy"[i], 10 * (i + 2)) for i, w in enumerate(TENS)}
WORDS |= {w: ("f" if i == 1 else "o" if i < 10 else "L" if i < 13 else "T", i) for i, w in enumerate(ORDINAL_UNITS) if i}
WORDS |= {w: ("WXYYYYYY"[i], 10 * (i + 2)) for i, w in enumerate(ORDINAL_TENS)}
WORDS |= {"oh": ("z", 0), "hundred": ("h", 100), "hundredth": ("H", 100)} | SCALES | {f"{w}th": ("k", n) for w, (_, n) in SCALES.items()}
WORDS |= {w: ("m", 0) for w in MONTHS} | {w: ("D", 0) for w in SIGNS} | {w: ("c", 0) for w in ("cent", "cents")}
WORDS |= {"and": ("a", 0), "point": ("p", 0), "percent": ("%", 0), "of": ("F", 0), "the": ("@", 0), "am": ("A", 0), "a.m": ("A", 0), "pm": ("A", 1), "p.m": ("A", 1), "o'clock": ("C", 0), "half": ("q", 30), "quarter": ("q", 15), "past": ("P", 0), "to": ("N", 0)}

_NUMBER = "zeultwxvyhKMB"
_BELOW_100 = "(?:[wxvy][eu]?|[eultz])"
_BELOW_1000 = f"(?:[eult]ha?{_BELOW_100}|[eult]h|{_BELOW_100})"
_CARDINAL = f"(?:(?:{_BELOW_1000}B)?(?:a?{_BELOW_1000}M)?(?:a?{_BELOW_1000}Ka?)?(?:{_BELOW_1000})?)(?<=[{_NUMBER}])"
_DECIMAL = f"{_CARDINAL}p[zeu]+"
_QUANTITY = f"(?:{_DECIMAL}[MB]?|{_CARDINAL})"
_LAST = "(?:[wxvy]?[fo]|[LTWXY])"
_ORDINAL = f"(?:(?:{_BELOW_1000}B)?(?:a?{_BELOW_1000}M)?(?:a?{_BELOW_1000}Ka?)?(?:[eult]ha?{_LAST}|[eult]H|{_LAST})|{_BELOW_1000}k)"
_DAY = "(?:w?[fo]|w?[eu]|xf|xe|[LTWXltwx])"
_YEAR = "(?:[eu]Ka?(?:[wxvy][eu]?|[eult])?|[wt](?:[wxvy][eu]?|[lt]|z[eu]))"
_DATE = f"(?:m{_DAY}{_YEAR}?|@?{_DAY}Fm{_YEAR}?)"
_MINUTE = "(?:z[eu]|[lt]|[wxv][eu]?)"
_TIME = f"(?:[eul]{_MINUTE}?A|[eul]C|q[PN][eul])"
_MONEY = f"(?:{_QUANTITY}D(?:a?{_BELOW_100}c)?|{_BELOW_100}c)"
#: In this order at each place.
FORMS = (("date", _DATE), ("time", _TIME), ("money", _MONEY), ("percent", f"{_QUANTITY}%"), ("decimal", _DECIMAL), ("ordinal", _ORDINAL), ("cardinal", _CARDINAL))
_EDGE = f"{_NUMBER}foLTWXYHk"
_CLOSED = ("money", "percent")  # their last word is no number, so any may follow
_FORM = rf"(?<![{_EDGE}]|[{_EDGE}]p)(?:" + "|".join(p if name in _CLOSED else rf"{p}(?![{_EDGE}])" for name, p in FORMS) + ")"
_SINGLE = "[fo]"

_CORE = r"^(?s)\s*(.*?)[.,!?;:]*$"
_longest = lambda symbols: "|".join(sorted((w.replace(".", r"\.") for w, (s, _) in WORDS.items() if s in symbols), key=lambda w: (-len(w), w)))
_LEAD, _NUMBERS, _ANY = _longest("m@qPN"), _longest(_EDGE), _longest("".join(s for s, _ in WORDS.values()))
_STOPS = "[.,!?;:]"
#: A number word with what may lead to it, and the words of the grammar after it; possessive, so that long runs need no stack.
RUN = rf"(?i)(?U)(?<!\S)(?:(?:{_LEAD})\s+){{0,2}}(?:{_NUMBERS})(?={_STOPS}*(?!\S))(?:{_STOPS}*\s+(?:{_ANY})(?={_STOPS}*(?!\S)))*+{_STOPS}*"
HYPHEN = rf"(?i)(?<![\p{{L}}\p{{N}}-])({'|'.join(TENS)})-(?=(?:{'|'.join([*UNITS[1:10], *ORDINAL_UNITS[1:10]])})(?![\p{{L}}\p{{N}}-]))"


def _table(values: dict) -> Column:
    quoted = lambda x: "'" + x.replace("'", "\\'") + "'" if isinstance(x, str) else str(x)
    return F.expr("map(" + ", ".join(f"{quoted(k)}, {quoted(v)}" for k, v in values.items()) + ")")


_VALUES = {w: n for w, (_, n) in WORDS.items()}


def _value(names: Column) -> Column:
    """The number that the words spell: groups below a thousand, each times its scale."""
    table = _table(_VALUES)
    scales = [w + end for w in SCALES for end in ("", "th")]

    def step(s: Column, w: Column) -> Column:
        n = F.coalesce(F.element_at(table, w), F.lit(0)).cast("bigint")
        scaled = F.struct((s["total"] + s["group"] * n).alias("total"), F.lit(0).cast("bigint").alias("group"))
        hundred = F.struct(s["total"].alias("total"), (s["group"] * 100).alias("group"))
        added = F.struct(s["total"].alias("total"), (s["group"] + n).alias("group"))
        return F.when(w.isin(*scales), scaled).when(w.isin("hundred", "hundredth"), hundred).otherwise(added)

    zero = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("group"))
    return F.aggregate(names, zero, step, lambda s: s["total"] + s["group"])


def _digits(names: Column) -> Column:
    table = _table({w: str(n) for w, n in _VALUES.items()})
    return F.array_join(F.transform(names, lambda w: F.element_at(table, w)), "")


def _first(names: Column, n: Column) -> Column:
    return F.slice(names, F.lit(1), n)


def _after(names: Column, n: Column) -> Column:
    return F.slice(names, n + 1, F.greatest(F.size(names) - n, F.lit(0)))


def _number(names: Column, symbols: Column) -> Column:
    """A cardinal, or a decimal with its scale as a word."""
    at, size = F.instr(symbols, "p"), F.length(symbols)
    scaled = symbols.rlike("p.*[MB]$")
    decimal = F.concat(_value(_first(names, at - 1)).cast("string"), F.lit("."), _digits(F.slice(names, at + 1, F.greatest(size - at - scaled.cast("int"), F.lit(0)))), F.when(scaled, F.concat(F.lit(" "), F.element_at(names, -1))).otherwise(""))
    return F.when(at > 0, decimal).otherwise(_value(names).cast("string"))


def _year(names: Column, symbols: Column) -> Column:
    """Two and two digits, or thousands."""
    pair = _value(_first(names, F.lit(1))) * 100 + _value(_after(names, F.lit(1)))
    return F.when(symbols == "", "").otherwise(F.concat(F.lit(" "), F.when(symbols.contains("K"), _value(names)).otherwise(pair).cast("string")))


def _date(names: Column, symbols: Column) -> Column:
    month_first = symbols.startswith("m")
    lead = F.length(F.regexp_extract(symbols, f"^(?:m{_DAY}|@?{_DAY}Fm)(?={_YEAR}?$)", 0))
    day = F.when(month_first, F.slice(names, F.lit(2), lead - 1)).otherwise(_first(names, F.greatest(lead - 2, F.lit(0))))
    month = F.when(month_first, F.get(names, F.lit(0))).otherwise(F.get(names, lead - 1))
    said = _value(day).cast("string")
    return F.concat(F.when(month_first, F.concat_ws(" ", month, said)).otherwise(F.concat_ws(" ", said, month)), _year(_after(names, lead), F.substring(symbols, lead + 1, F.length(symbols))))


def _time(names: Column, symbols: Column) -> Column:
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    minutes = _value(_first(names, F.lit(1)))
    named = _value(_after(names, F.lit(2)))
    hour = F.when(symbols.contains("P"), named).otherwise((named + 10) % 12 + 1)
    turned = F.concat(two(hour), F.lit(":"), two(F.when(symbols.contains("P"), minutes).otherwise(60 - minutes)))
    half = F.when(F.element_at(names, -1).startswith("p"), " p.m.").otherwise(" a.m.")
    inside = F.slice(names, F.lit(2), F.greatest(F.size(names) - 2, F.lit(0)))
    plain = F.concat(two(_value(_first(names, F.lit(1)))), F.lit(":"), two(_value(inside)), F.when(symbols.endswith("A"), half).otherwise(""))
    return F.when(symbols.startswith("q"), turned).otherwise(plain)


def _money(names: Column, symbols: Column) -> Column:
    at = F.instr(symbols, "D")
    sign = F.element_at(_table(SIGNS), F.get(names, F.greatest(at - 1, F.lit(0))))
    cents = F.lpad(_value(F.filter(_after(names, at), lambda w: ~w.isin("cent", "cents"))).cast("string"), 2, "0")
    whole = F.concat(sign, _number(_first(names, at - 1), F.substring(symbols, F.lit(1), at - 1)))
    return F.when(at == 0, F.concat(F.lit("$0."), cents)).when(symbols.endswith("c"), F.concat(whole, F.lit("."), cents)).otherwise(whole)


def _ordinal(names: Column, symbols: Column) -> Column:
    def ended(n: Column) -> Column:
        tail = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
        return F.concat(n.cast("string"), tail)

    return let(_value(names), ended)


_WRITERS = {"date": _date, "time": _time, "money": _money, "ordinal": _ordinal, "percent": lambda n, s: F.concat(_number(_first(n, F.size(n) - 1), F.substring(s, F.lit(1), F.length(s) - 1)), F.lit("%")), "decimal": _number, "cardinal": _number}


def _written(names: Column, symbols: Column) -> Column:
    """The written form of a match, by the first form that its symbols are."""
    out = F.when(symbols.rlike(f"^{FORMS[0][1]}$"), _WRITERS[FORMS[0][0]](names, symbols))
    for name, pattern in FORMS[1:]:
        out = out.when(symbols.rlike(f"^{pattern}$"), _WRITERS[name](names, symbols))
    return out


def _rewrite(text: Column) -> Column:
    table = _table({w: s for w, (s, _) in WORDS.items()})
    names = lambda tokens: F.transform(tokens, lambda w: F.lower(F.regexp_extract(w, _CORE, 1)))

    def by_token(tokens: Column) -> Column:
        def by_name(name: Column) -> Column:
            closed = lambda w: F.when(w.rlike("[.,!?;:]$"), "|").otherwise("")
            symbols = F.array_join(F.zip_with(tokens, name, lambda w, n: F.concat(F.coalesce(F.element_at(table, n), F.lit(".")), closed(w))), "")
            marked = F.regexp_replace(F.regexp_replace(symbols, _FORM, "<$0>"), f"<({_SINGLE})>", "$1")
            return let(F.regexp_extract_all(marked, F.lit(r"<?[^<>|]>?\|?"), F.lit(0)), lambda marks: _joined(tokens, name, marks))

        return let(names(tokens), by_name)

    return F.concat(let(pieces(text), by_token), F.regexp_extract(text, r"(?U)\s*$", 0))


def _joined(tokens: Column, names: Column, marks: Column) -> Column:
    """The tokens with each marked run in its written form, with the white space before it and the mark after it."""
    numbered = F.transform(marks, lambda m, i: F.struct(m.alias("m"), i.alias("i")))
    starts = F.transform(F.filter(numbered, lambda x: x["m"].startswith("<")), lambda x: x["i"])
    ends = F.transform(F.filter(numbered, lambda x: x["m"].contains(">")), lambda x: x["i"] + 1)

    def build(both: Column) -> Column:
        def one(start: Column, end: Column) -> Column:
            inside = F.slice(marks, start + 1, end - start)
            symbols = F.regexp_replace(F.array_join(inside, ""), r"[<>|]", "")
            said = _written(F.slice(names, start + 1, end - start), symbols)
            last = F.get(tokens, end - 1)
            blank, tail = F.regexp_extract(F.get(tokens, start), r"(?U)^\s*", 0), F.regexp_extract(last, r"[.,!?;:]*$", 0)
            # the written half of a day has its own full stop
            tail = F.when(symbols.endswith("A") & tail.startswith("."), F.substring(tail, 2, 99)).otherwise(tail)
            return F.concat(blank, said, tail)

        s, e = both["s"], both["e"]
        gaps = F.zip_with(F.concat(F.array(F.lit(0)), e), F.concat(s, F.array(F.size(tokens))), lambda a, b: F.array_join(F.slice(tokens, a + 1, b - a), ""))
        made = F.concat(F.zip_with(s, e, one), F.array(F.lit("")))
        return F.array_join(F.zip_with(gaps, made, lambda g, m: F.concat(g, m)), "")

    return let(F.struct(starts.alias("s"), ends.alias("e")), lambda both: F.when(F.size(both["s"]) == 0, F.array_join(tokens, "")).otherwise(build(both)))


def english_written(text: Column | str) -> Column:
    """Spoken numbers in their written forms; a text without one stays as it is."""
    t = col(text)

    def apart(whole: Column) -> Column:
        runs = F.transform(F.regexp_extract_all(whole, F.lit(RUN), F.lit(0)), _rewrite)
        return F.array_join(F.zip_with(F.split(whole, RUN, -1), F.concat(runs, F.array(F.lit(""))), lambda gap, run: F.concat(gap, run)), "")

    joined = F.when(t.rlike(HYPHEN), F.regexp_replace(t, HYPHEN, "$1 ")).otherwise(t)
    return F.when(t.rlike(RUN) | t.rlike(HYPHEN), let(joined, apart)).otherwise(t)

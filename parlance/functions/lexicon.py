"""Word lists, cues and replacements by language, as the semantics require them."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class FillerLexicon:
    """Words removed anywhere, words removed at a sentence's start, and pairs removed as units."""

    pure: tuple[str, ...] = ()
    contextual: tuple[str, ...] = ()
    pairs: tuple[tuple[str, str], ...] = ()
    stop: tuple[str, ...] = field(default=())


ENGLISH = FillerLexicon(
    pure=("um", "uh", "uhm", "umm", "hmm", "er", "ah", "eh"),
    contextual=("so", "well", "basically", "actually", "literally", "right"),
    pairs=(("you", "know"), ("i", "mean"), ("you", "see"), ("sort", "of"), ("kind", "of")),
)
KOREAN = FillerLexicon(
    pure=("음", "어", "아", "으", "엄", "응"),
    contextual=("그", "저", "막", "약간", "뭐", "저기", "글쎄", "그러니까", "그니까", "그래서", "어쨌든", "그게", "뭐랄까"),
    pairs=(("음", "그러니까"), ("그게", "그러니까"), ("뭐랄까", "그")),
)
JAPANESE_WORDS = FillerLexicon(
    pure=("えーと", "えっと", "えー", "あー", "うーん", "うん", "ああ", "ええ", "映像", "映映"),
    contextual=("あの", "まあ", "その", "なんか", "ほら", "やっぱり", "まあまあ", "ちょっと"),
    pairs=(("なんて", "いうか"), ("何て", "いうか")),
)
JAPANESE = FillerLexicon(pure=JAPANESE_WORDS.pure, contextual=("あの", "まあ", "その", "なんか", "ほら", "やっぱり"))
CHINESE = FillerLexicon(pure=("嗯", "呃", "哦", "唉", "呀"), contextual=("那个", "这个", "就是", "然后", "怎么说"))
SPANISH = FillerLexicon(
    pure=("e", "eh", "ehh", "ehhh", "eee", "eeh", "eeeh", "ehm", "mm", "mmm", "hmm", "ah", "aah", "ahh", "oh"),
    pairs=(("o", "sea"),),
    stop=("y", "a", "o", "u", "e", "de", "en", "el", "la", "lo", "los", "las", "le", "les", "un", "una", "uno", "unos", "unas", "se", "te", "me", "nos", "os", "no", "ni", "es", "ya", "si", "sí", "por", "con", "para", "del", "al", "que", "qué", "su", "sus", "mi", "mis", "tu", "tus"),
)

# Correction cues; each list is tried from the longest to the shortest, equals as they stand.
CUES = {
    "en": ("no", "wait", "sorry", "i mean", "actually", "rather", "no wait", "or rather"),
    "ja": ("いや", "じゃなくて", "じゃなく", "ではなく", "ていうか", "っていうか", "じゃない"),
    "es": ("mejor dicho", "quiero decir", "o sea", "perdón", "mejor", "digo", "no es", "no"),
    "zh": ("我的意思是", "确切地说", "应该说", "我是说", "不对", "不是", "算了"),
    "ko": ("그게 아니라", "그게 아니고", "잘못 말했다", "잘못 말했네", "아 잠깐", "잠깐만", "아니에요", "아니라", "아니야", "아니"),
}


def cues(lang: str) -> list[str]:
    return sorted(CUES[lang], key=len, reverse=True)


SPOKEN_FORMS = {
    "gonna": "going to", "wanna": "want to", "gotta": "got to", "hafta": "have to", "oughta": "ought to", "tryna": "trying to",
    "gimme": "give me", "lemme": "let me", "kinda": "kind of", "sorta": "sort of", "outta": "out of", "lotta": "lot of",
    "dunno": "don't know", "c'mon": "come on", "'cause": "because", "cuz": "because", "y'all": "you all",
}

# Characters dropped, and characters that split words, before lenient comparison.
DROPPED = ".,?!:;\"'()[]{}" + "。、「」『』・" + "？！：；（），．" + "《》〈〉〝〟" + "…‘’“”"
SPLITTING = "-–—−―"

UNITS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen")
TENS = ("twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")
SCALES = {"hundred": 100, "thousand": 1000, "million": 1000000}
IRREGULAR_ORDINALS = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}


def english_numbers() -> dict[str, str]:
    """Number words and ordinals as digits; ordinals keep their ending."""
    value = {w: i for i, w in enumerate(UNITS)} | {w: 10 * (i + 2) for i, w in enumerate(TENS)} | SCALES
    out = {w: str(n) for w, n in value.items()}
    for word, n in value.items():
        if n:
            ordinal = IRREGULAR_ORDINALS.get(word) or (word[:-1] + "ieth" if word.endswith("y") else word + "th")
            out[ordinal] = f"{n}{ {1: 'st', 2: 'nd', 3: 'rd'}.get(n, 'th') }"
    return out


ZH_DIGITS = "零一二三四五六七八九"
ZH_UNITS = "十百千万亿"
KO_DIGITS = {"영": 0, "공": 0, "일": 1, "이": 2, "삼": 3, "사": 4, "오": 5, "육": 6, "칠": 7, "팔": 8, "구": 9}
KO_SMALL = {"십": 10, "백": 100, "천": 1000}
KO_LARGE = {"만": 10**4, "억": 10**8, "조": 10**12}
KO_CLASSIFIERS = ("년", "월", "일", "시", "분", "초", "세트")
SEPARATORS = "、，。？！,.;:!?"
FIELD_TYPES = ("CodeEditor", "EmailCompose", "ChatMessage", "Terminal", "Document", "SearchBar", "Generic")
UNSPLIT_FIELDS = ("ChatMessage", "Terminal", "SearchBar", "CodeEditor")

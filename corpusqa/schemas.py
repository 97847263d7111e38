"""Explicit schemas of the tables that the operators read and write, and language packs."""

from __future__ import annotations

from dataclasses import dataclass, field

SECTIONS = "corpus STRING, seq BIGINT, text STRING"
FINDINGS = "corpus STRING, rule STRING, severity STRING, seq BIGINT, subject STRING, n BIGINT, detail STRING"
CUSTODY = "chains ARRAY<STRUCT<id: STRING, steps: ARRAY<STRUCT<ch: INT, holder: STRING, anchors: ARRAY<STRING>, handover: ARRAY<STRING>>>, terminal: STRUCT<ch: INT, why: STRING, forbid_after: ARRAY<STRING>>>>"

#: White space beyond ASCII, as a character class of both Java's and RE2's expressions.
SPACE = r"[\s\x{0B}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"

#: The same characters, as a list.
SPACES = " \t\n\x0b\x0c\r\xa0\u1680\u180e" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Fixed value: a sentence of marks only.
MARKS_ONLY = r"""^[“”‘’"'（）()《》、，—…\-.]+$"""


@dataclass(frozen=True)
class LangPack:
    """What the operators must know of a language."""

    terminators: str
    openers: tuple[str, ...]
    closers: tuple[str, ...]
    punctuation: str
    stops: str = "。！？"
    # Verbs of saying, characters of address, verbs of attribution, time markers, denials.
    say: str = "说|问|答|喊|道"
    address: str = "对向跟和与替给叫让催问求告带扶看喊教拉推拍"
    attribution: str = "[说道问答喊叫喝应念]"
    scene: str = "同一夜|次日|第二天|当夜|夜裏|夜里|入夜|天亮|天明|后半夜|半月|数日后|三日后|晌午|午后|清晨|傍晚|[一二三四五六七八九十]{1,3}月|[0-9]{3,4}年"
    negation: str = "不是[^，。！？\n]{1,22}[，]?(?:而是|是)"
    lexicon: tuple[str, ...] = field(default_factory=tuple)


#: Numerals of volume numbers.
NUMERALS = {"一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10, "十一": 11, "十二": 12, "十三": 13, "十四": 14, "十五": 15, "十六": 16, "十七": 17, "十八": 18, "十九": 19, "二十": 20}

#: The default lexicon of stock phrases.
TICS = ("至少", "其实", "反而", "也就是说", "换句话说", "更重要的是", "值得注意的是", "归根到底", "事实上", "这意味着", "不难看出", "某种意义上", "恰恰", "无非", "终究", "本来", "并不")

CJK = LangPack(terminators="[。！？；!?;\n]", openers=("“", "「"), closers=("”", "」"), punctuation="，。！？；：、…—“”‘’「」（）《》,.!?;:\"'()", lexicon=TICS)
LATIN = LangPack(terminators="[.!?;\n]", openers=('"',), closers=('"',), punctuation=",.!?;:\"'()", stops=".!?", say=" the| und| que| de", address="xz", attribution="(?:the|und|que)", negation="[A-Z][a-z]{4,8}", lexicon=("the", "und", "que", "ion", "ment"))

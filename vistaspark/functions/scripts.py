"""Latin spellings of the letters of ten scripts (survey X2), beside those in ``text``.

Fixed values, in the order of the scripts: pairs of a letter and its spelling, a letter alone
having none. Syllabaries are made by their rule. Chinese readings are a parameter; the ones
here are those of common words in the names of mountains.
"""

from __future__ import annotations


def _pairs(told: str) -> dict[str, str]:
    return {x.split()[0]: (x.split() + [""])[1] for x in told.split(",")}


ARMENIAN = _pairs("ա a, բ b, գ g, դ d, ե e, զ z, է e, ը y, թ th, ժ zh, ի i, լ l, խ kh, ծ ts, կ k, հ h, ձ dz, ղ gh, ճ ch, մ m, յ y, ն n, շ sh, ո o, չ ch, պ p, ջ j, ռ r, ս s, վ v, տ t, ր r, ց ts, փ ph, ք q, և ew, օ o, ֆ f")
GREEK = _pairs("α a, β v, γ g, δ d, ε e, ζ z, η i, θ th, ι i, κ k, λ l, μ m, ν n, ξ x, ο o, π p, ρ r, σ s, ς s, τ t, υ i, φ f, χ ch, ψ ps, ω o, Ά A, Έ E, Ή I, Ί I, Ό O, Ύ I, Ώ O")
ARABIC = _pairs("ا a, ب b, ت t, ث th, ج j, ح h, خ kh, د d, ذ dh, ر r, ز z, س s, ش sh, ص s, ض d, ط t, ظ z, ع a, غ gh, ف f, ق q, ك k, ل l, م m, ن n, ه h, و w, ي y, ى a, ة a, ء, ئ y, ؤ w")
TIBETAN = _pairs("ཀ ka, ཁ kha, ག ga, ང nga, ཅ ca, ཆ cha, ཇ ja, ཉ nya, ཏ ta, ཐ tha, ད da, ན na, པ pa, ཕ pha, བ ba, མ ma, ཙ tsa, ཚ tsha, ཛ dza, ཝ wa, ཞ zha, ཟ za, འ a, ཡ ya, ར ra, ལ la, ཤ sha, ས sa, ཧ ha, ཨ a")
DEVANAGARI = _pairs(
    "अ a, आ aa, इ i, ई ii, उ u, ऊ uu, ए e, ऐ ai, ओ o, औ au, क k, ख kh, ग g, घ gh, ङ ng, च c, छ ch, ज j, झ jh, ञ ny, ट t, ठ th, ड d, ढ dh, ण n, त t, थ th, द d, ध dh, न n, प p, फ ph, ब b, भ bh, म m, "
    "य y, र r, ल l, व v, श sh, ष sh, स s, ह h, ा a, ि i, ी i, ु u, ू u, े e, ै ai, ो o, ौ au, ्"
)
THAI = _pairs(
    "ก k, ข kh, ฃ kh, ค kh, ฅ kh, ฆ kh, ง ng, จ j, ฉ ch, ช ch, ซ s, ฌ ch, ญ y, ฎ d, ฏ t, ฐ th, ฑ th, ฒ th, ณ n, ด d, ต t, ถ th, ท th, ธ th, น n, บ b, ป p, ผ ph, ฝ f, พ ph, ฟ f, ภ ph, ม m, ย y, ร r, ฤ rue, ล l, ว w, ศ s, ษ s, ส s, ห h, ฬ l, อ o, ฮ h"
)
#: Ethiopic: the first syllable of each consonant; its seven vowels follow each other.
ETHIOPIC_ROWS = _pairs("ሀ h, ለ l, መ m, ረ r, ሰ s, ቀ q, በ b, ተ t, ነ n, የ y, ደ d, ገ g, ጠ t, ፈ f")
ETHIOPIC_VOWELS = ("e", "u", "i", "a", "e", "", "o")
#: Katakana in rows of five vowels, a dot for a gap; the hiragana stand 96 places before.
KANA_ROWS = {"": "アイウエオ", "k": "カキクケコ", "s": "サシスセソ", "t": "タチツテト", "n": "ナニヌネノ", "h": "ハヒフヘホ", "m": "マミムメモ", "y": "ヤ.ユ.ヨ", "r": "ラリルレロ", "w": "ワ...ヲ", "g": "ガギグゲゴ", "z": "ザジズゼゾ", "d": "ダヂヅデド", "b": "バビブベボ", "p": "パピプペポ"}
KANA_ODD = _pairs("シ shi, チ chi, ツ tsu, フ fu, ジ ji, ヂ ji, ヅ zu, ン n, ー -")
#: Hangul: the letters of a syllable by their numbers.
INITIALS = ("g", "kk", "n", "d", "tt", "r", "m", "b", "pp", "s", "ss", "", "j", "jj", "ch", "k", "t", "p", "h")
MEDIALS = ("a", "ae", "ya", "yae", "eo", "e", "yeo", "ye", "o", "wa", "wae", "oe", "yo", "u", "wo", "we", "wi", "yu", "eu", "ui", "i")
FINALS = ("", "k", "k", "k", "n", "n", "n", "t", "l", "k", "m", "l", "l", "l", "p", "l", "m", "p", "p", "t", "t", "ng", "t", "t", "k", "t", "p", "t")
CHINESE = _pairs(
    "一 yi, 三 san, 上 shang, 下 xia, 东 dong, 中 zhong, 云 yun, 五 wu, 仑 lun, 北 bei, 华 hua, 南 nan, 古 gu, 台 tai, 喀 ka, 喜 xi, 大 da, 天 tian, 太 tai, 姑 gu, 娘 niang, 四 si, 小 xiao, 尔 er, 山 shan, 岩 yan, 岭 ling, 岱 dai, 峡 xia, 峨 e, 峰 feng, 崖 ya, "
    "嵩 song, 川 chuan, 庐 lu, 恒 heng, 拉 la, 昆 kun, 朗 lang, 林 lin, 格 ge, 横 heng, 武 wu, 水 shui, 江 jiang, 河 he, 泉 quan, 泰 tai, 海 hai, 湖 hu, 玉 yu, 玛 ma, 珠 zhu, 白 bai, 眉 mei, 石 shi, 穆 mu, 红 hong, 花 hua, 藏 cang, 衡 heng, 西 xi, 谷 gu, 贡 gong, 里 li, "
    "金 jin, 银 yin, 长 zhang, 阿 a, 雅 ya, 青 qing, 顶 ding, 马 ma, 高 gao, 黄 huang, 黑 hei, 龙 long"
)


def ethiopic() -> dict[str, str]:
    """Each consonant with its vowels; the first form of h is spelled with an a."""
    made = {chr(ord(first) + k): consonant + vowel for first, consonant in ETHIOPIC_ROWS.items() for k, vowel in enumerate(ETHIOPIC_VOWELS)}
    return made | {"ሀ": "ha"}


def kana() -> dict[str, str]:
    rows = {c: consonant + vowel for consonant, row in KANA_ROWS.items() for c, vowel in zip(row, "aiueo", strict=True) if c != "."} | KANA_ODD
    return rows | {chr(ord(c) - 96): v for c, v in rows.items() if c != "ー"}


def hangul(syllable: str) -> str:
    """A syllable by the numbers of its letters."""
    n = ord(syllable) - 0xAC00
    return INITIALS[n // 588] + MEDIALS[n % 588 // 28] + FINALS[n % 28]


def others() -> dict[str, str]:
    """All tables of letters but the Hangul, which has a rule, and Chinese, whose readings are told."""
    return ARMENIAN | GREEK | ARABIC | TIBETAN | DEVANAGARI | THAI | ethiopic() | kana()

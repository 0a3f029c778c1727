"""Braille tables of the public standards (six-dot Braille ASCII, Korean braille), as plain text."""

from __future__ import annotations

# Braille ASCII; the place of a character is its dot mask (dot 1 = bit 0 ... dot 6 = bit 5).
BRAILLE_ASCII = " a1b'k2l@cif/msp\"e3h9o6r^djg>ntq,*5<-u8v.%[$+x!&;:4\\0z7(_?w]#y)="
# Another spelling of the cell @.
ALIAS = "`"

# Jamo in Unicode order.
INITIALS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
VOWELS = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
FINALS = ["", *"ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"]

# Cells of the jamo in Unicode order. The initial ㅇ is not written.
INITIAL_CELLS = {
    "ㄱ": "@", "ㄲ": ",@", "ㄴ": "c", "ㄷ": "i", "ㄸ": ",i", "ㄹ": "\"", "ㅁ": "e", "ㅂ": "^", "ㅃ": ",^", "ㅅ": ",", "ㅆ": ",,", "ㅈ": ".", "ㅉ": ",.", "ㅊ": ";",
    "ㅋ": "f", "ㅌ": "h", "ㅍ": "d", "ㅎ": "j",
}
VOWEL_CELLS = {
    "ㅏ": "<", "ㅐ": "r", "ㅑ": ">", "ㅒ": ">r", "ㅓ": "s", "ㅔ": "n", "ㅕ": ":", "ㅖ": "/", "ㅗ": "u", "ㅘ": "v", "ㅙ": "vr", "ㅚ": "y", "ㅛ": "+", "ㅜ": "m",
    "ㅝ": "p", "ㅞ": "pr", "ㅟ": "mr", "ㅠ": "%", "ㅡ": "[", "ㅢ": "w", "ㅣ": "o",
}
FINAL_CELLS = {
    "ㄱ": "a", "ㄲ": "aa", "ㄳ": "a'", "ㄴ": "3", "ㄵ": "3k", "ㄶ": "30", "ㄷ": "9", "ㄹ": "1", "ㄺ": "1a", "ㄻ": "15", "ㄼ": "1b", "ㄽ": "1'", "ㄾ": "18",
    "ㄿ": "14", "ㅀ": "10", "ㅁ": "5", "ㅂ": "b", "ㅄ": "b'", "ㅅ": "'", "ㅆ": "/", "ㅇ": "7", "ㅈ": "k", "ㅊ": "2", "ㅋ": "6", "ㅌ": "8", "ㅍ": "4", "ㅎ": "0",
}

# Cells that stand for an initial with the vowel ㅏ.
WITH_A = {
    "ㄱ": "$", "ㄴ": "c", "ㄷ": "i", "ㅁ": "e", "ㅂ": "^", "ㅅ": "l", "ㅈ": ".", "ㅋ": "f", "ㅌ": "h", "ㅍ": "d", "ㅎ": "j",
}
# Cells that stand for a vowel with a final.
RIMES = {
    ("ㅓ", "ㄱ"): "?", ("ㅓ", "ㄴ"): ")", ("ㅓ", "ㄹ"): "t", ("ㅕ", "ㄴ"): "*", ("ㅕ", "ㄹ"): "\\", ("ㅕ", "ㅇ"): "]", ("ㅗ", "ㄱ"): "x", ("ㅗ", "ㄴ"): "(",
    ("ㅗ", "ㅇ"): "=", ("ㅜ", "ㄴ"): "g", ("ㅜ", "ㄹ"): "&", ("ㅡ", "ㄴ"): "z", ("ㅡ", "ㄹ"): "!", ("ㅣ", "ㄴ"): "q",
}
# The cell ] after these initials is read so.
YEONG = {
    "ㅅ": "성", "ㅆ": "썽", "ㅈ": "정", "ㅉ": "쩡", "ㅊ": "청",
}
GEOT = ("것", "_s")
# Word abbreviations.
WORDS = {
    "그러나": "ac", "그러면": "a3", "그러므로": "a5", "그런데": "an", "그래서": "as", "그리고": "au", "그리하여": "a:",
}

# Digits 1-9 and 0, and circled digits.
DIGITS, DIGIT_CELLS = "1234567890", "abcdefghij"
CIRCLED, CIRCLED_CELLS = "①②③④⑤", "abcde"

# Cells of ink punctuation when encoding.
INK_PUNCTUATION = {
    ".": "4", "!": "6", "?": "8", ",": "1", ":": "3", "-": "-", "(": "8'", ")": ",0", "[": "82", "]": ";0", '"': "8", "'": "'",
    "‘": ",8", "’": "0'", "“": "8", "”": "0", "『": ";8", "』": "02", "「": '"8', "」": "01", "…": "444", "·": "1;", "～": "-", "~": "-",
    "/": "/", "=": "=", "*": "99", "※": "99", "ⓒ": "7c7", "〈": "7", "〉": "7", "<": "7", ">": "7",
}
# Punctuation of two and three cells when decoding (the last two mark emphasis and leave nothing).
CELL_PUNCTUATION = {
    ",8": "‘", "0'": "’", ";8": "『", "02": "』", '"8': "「", "01": "」", "8'": "(", ",0": ")", "82": "[", ";0": "]",
    "1;": "·", "--": "–", "88": "“", "00": "”", "99": "*", "7c7": "ⓒ", ",-": "", "-'": "",
}
# Punctuation of one cell when decoding.
CELL_MARKS = {"4": ".", "6": "!", "8": "?", "1": ",", "-": "-"}
NUMBER_SIGN, ROMAN_SIGN, LETTER_SIGN, ON_SIGN, TENSE_SIGN = "#", "0", ";", "=", ","

# Vocabularies.
NAVIGABLE = ["PassageGroup", "Passage", "Question", "Prompt", "Choice", "ExampleBox", "Footnote", "Instruction"]
TAG_PRIORITY = ["Header", "Footer", "EndNotice", "PassageGroup", "Question", "Choice", "ExampleBox", "Footnote"]
SEPARATOR_ROW = "=" + "g" * 30 + "="


def _syllables() -> list[str]:
    """Cells of the 11,172 syllables in Unicode order: 것; then ㅇ + rime as the rime's cell; then initial +
    rime; then initial with ㅏ as one cell; else spelled out. ㄱ is written with its other spelling."""
    first = {k: v.replace("@", ALIAS) for k, v in INITIAL_CELLS.items()} | {"ㅇ": ""}
    out = []
    for i in INITIALS:
        for v in VOWELS:
            for f in FINALS:
                if (i, v, f) == ("ㄱ", "ㅓ", "ㅅ"):
                    out.append(GEOT[1])
                elif (v, f) in RIMES:
                    out.append(first[i] + RIMES[v, f])
                elif v == "ㅏ" and i in WITH_A:
                    out.append(WITH_A[i] + FINAL_CELLS.get(f, ""))
                else:
                    out.append(first[i] + VOWEL_CELLS[v] + FINAL_CELLS.get(f, ""))
    return out


SYLLABLES = _syllables()

"""Devanagari in Latin letters, as people type it: long a doubled, the final inherent vowel dropped."""

from __future__ import annotations

VOWEL = {"अ": "a", "आ": "aa", "इ": "i", "ई": "i", "उ": "u", "ऊ": "u", "ऋ": "ri", "ए": "e", "ऐ": "ai", "ओ": "o", "औ": "au"}
SIGN = {"ा": "aa", "ि": "i", "ी": "i", "ु": "u", "ू": "u", "ृ": "ri", "े": "e", "ै": "ai", "ो": "o", "ौ": "au"}
CONSONANT = {
    "क": "k", "ख": "kh", "ग": "g", "घ": "gh", "ङ": "ng", "च": "ch", "छ": "chh", "ज": "j", "झ": "jh", "ञ": "ny", "ट": "t", "ठ": "th", "ड": "d", "ढ": "dh", "ण": "n", "त": "t", "थ": "th", "द": "d", "ध": "dh", "न": "n",
    "प": "p", "फ": "ph", "ब": "b", "भ": "bh", "म": "m", "य": "y", "र": "r", "ल": "l", "व": "w", "श": "sh", "ष": "sh", "स": "s", "ह": "h",
}
OTHER = {"ं": "n", "ँ": "n", "ः": "", "़": "", "‍": "", "‌": "", "।": ".", "ऽ": ""}
DIGITS = str.maketrans("०१२३४५६७८९", "0123456789")


def romanise(text: str) -> str:
    out: list[str] = []
    text = text.translate(DIGITS)
    for i, c in enumerate(text):
        if c in CONSONANT:
            out.append(CONSONANT[c])
            j = i + 1
            while j < len(text) and text[j] in "़":
                j += 1
            nxt = text[j] if j < len(text) else ""
            if nxt in SIGN or nxt == "्":
                continue
            inside = nxt in CONSONANT or nxt in VOWEL or nxt in "ंँः" and nxt != ""
            # The inherent vowel stays at the end only after a cluster or alone.
            if inside or (i and text[i - 1] == "्") or not (i and (text[i - 1] in CONSONANT or text[i - 1] in SIGN or text[i - 1] in VOWEL or text[i - 1] in "ंँ")):
                out.append("a")
        elif c in VOWEL:
            out.append(VOWEL[c])
        elif c in SIGN:
            out.append(SIGN[c])
        elif c != "्":
            out.append(OTHER.get(c, c))
    return "".join(out)

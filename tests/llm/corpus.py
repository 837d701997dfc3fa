"""Invented texts for the tests."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, h long, rows int"


def words(rng, n):
    parts = "the of and tion ing er re th on an en es ha ti ou st sch lich keit elle eux ción".split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


def make_texts():
    """Texts with everything that may come: null, empty, blank, very long, copies, near copies, odd characters."""
    rng = random.Random(5)
    base = [words(rng, n) for n in (3, 5, 8, 30, 60, 120, 150, 200)]
    long = words(rng, 6000)
    near = base[6].split()
    near[10] = "changed"
    line = words(rng, 70)
    return [
        *base,
        None,
        "",
        None,
        " \n\t ",
        "... --- !!!",
        base[5],
        base[5],
        base[5].upper(),
        " ".join(near),
        long,
        long + " tail",
        "x" * 3000,
        "ab" * 700,
        words(rng, 40) + "\n" + line + "\n" + words(rng, 40),
        line,
        words(rng, 5) + " " + line + " " + words(rng, 9),
        "naïve café déjà-vu 日本語 テキスト 🎉 emoji space　wide",
        "<|endoftext|> special <|startoftext|> </s> <s> ▁ ▁▁x",
        "tabs\tand\r\nlines\n\n\nmore   spaces  \x1c odd \x85 end ",
        "stupid idiot and pathetic trash of a moron " + base[3],
        "\u0000 nul and é combining \U0001f600",
    ]

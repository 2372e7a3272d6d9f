"""Scalar text functions against Python's own string methods and literals."""

import pytest
from pyspark.sql import functions as F

from logdistill.functions import detect, signatures, text

TEXTS = [
    "", "a", "a\n", "a\n\n", "\n", "a\r\nb\rc\n", "a\x0bb\x0cc\x1cd\x1de\x1ef\x85g h i",
    " \t x 　\xa0", "\r\n", "x\r", " ", "é\n日本\n🙂🙂🙂🙂", "a\x1fb\x1f",
]


def one(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("t")).alias("x")).collect()]


def test_split_lines_is_splitlines(spark):
    assert one(spark, TEXTS, text.split_lines) == [t.splitlines() for t in TEXTS]


def test_lines_by_the_plain_way_are_the_same(spark):
    """Only texts of ASCII without odd white space are plain; lines do not depend on the way."""
    plain = ["a b \n  c\n\n   \n d", "\x00\x07\x1b[0m a\x7f \n~"]
    texts = [*TEXTS, *plain, *[f" {b}x{b} \n{b}\n y " for b in text.WHITESPACE + "\ufeff\u200b"]]
    odd = set(text.WHITESPACE) - {" ", "\n"}
    assert one(spark, texts, text.is_plain) == [t.isascii() and not odd & set(t) for t in texts]

    def lines(c):
        return text.content_lines(text.split_lines(c, text.is_plain(c)), text.is_plain(c))

    assert one(spark, texts, lines) == [[x.strip() for x in t.splitlines() if x.strip()] for t in texts]


def test_strip_is_strip(spark):
    assert one(spark, TEXTS, text.strip) == [t.strip() for t in TEXTS]
    assert one(spark, TEXTS, text.rstrip) == [t.rstrip() for t in TEXTS]


def test_token_estimate(spark):
    assert one(spark, TEXTS, text.token_estimate) == [len(t) // 4 for t in TEXTS]
    assert one(spark, TEXTS, lambda c: text.token_estimate(c, 1)) == [
        max(1, len(t) // 4) for t in TEXTS
    ]


@pytest.mark.parametrize(
    "raw,clean",
    [
        ("\x1b[31mred\x1b[0m", "red"),
        ("\x1b]0;title\x07text", "text"),
        ("\x1b]0;title\x1b\\text", "text"),
        ("\x1b[?25lhidden\x1b[?25h", "hidden"),
        ("a\x00b\x07c", "abc"),
        ("tab\tnew\nline\r", "tab\tnew\nline\r"),
        ("\x1bMup", "up"),
    ],
)
def test_sanitize(spark, raw, clean):
    assert one(spark, [raw], text.sanitize) == [clean]


def test_prompts(spark):
    yes = ["Continue? [Y/n]", "Password:", ">>> ", "ok?\n", "x" * 119 + "?", "Is it? yes\n"]
    no = ["", "done", "x" * 120 + "?", "a: b", "? " + "x" * 200]
    assert one(spark, yes, text.is_prompt) == [True] * len(yes)
    assert one(spark, no, text.is_prompt) == [False] * len(no)


def test_chunk_prompt_looks_at_last_bytes(spark):
    df = spark.createDataFrame(
        [(0, b"go (y/n)"), (1, b"(y/n)" + b"x" * 200), (2, b"(y/n)" + b"x" * 195)], "i int, b binary"
    )
    got = [r.x for r in df.orderBy("i").select(text.chunk_is_prompt(F.col("b")).alias("x")).collect()]
    assert got == [True, False, True]


def test_decode(spark):
    df = spark.createDataFrame(
        [(0, "é🙂".encode()), (1, b"caf\xe9"), (2, b"")], "i int, b binary"
    )
    got = [r.x for r in df.orderBy("i").select(text.decode_bytes(F.col("b")).alias("x")).collect()]
    assert got == ["é🙂", "café", ""]


HDR = "Traceback (most recent call last):"


def test_classify(spark):
    flood = "\n".join(["same"] * 10)
    cases = {
        HDR + "\n": "traceback",
        "log\n   " + HDR: "traceback",
        "\n\n \n" + HDR: "traceback",
        "print('" + HDR + "')": None,
        "x\r" + HDR: None,
        "\x1b[31m" + HDR: "traceback",
        "error[E0308]: no\n" + flood: "rust",
        " error[E0308]: no": None,
        "src/a.hpp:1:2: note: x": "gcc",
        "src/a.rs:1:2: error: x": None,
        flood: "flood",
        "\n".join(["same"] * 9): None,
        "\n".join(["same"] * 6 + list("abcd")): "flood",
        "\n".join(["same"] * 5 + list("abcde")): None,
        "\n".join(f"line {i}" for i in range(50)): None,
    }
    assert one(spark, list(cases), detect.classify) == list(cases.values())
    assert one(spark, list(cases), detect.matches) == [v is not None for v in cases.values()]


def test_incomplete_traceback(spark):
    frames = HDR + "\n" + '  File "a.py", line 1, in f\n    x()\n' * 10
    cases = {
        HDR: True, frames: True, frames + "\n  \n": True, frames + "KeyError: 1\n": False,
        "  " + HDR: True, "    plain": False, "": False,
    }
    assert one(spark, list(cases), detect.is_incomplete_traceback) == list(cases.values())


def test_frames(spark):
    line = '  File "/usr/lib/python3/x.py", line 2, in distlib_g'
    assert one(spark, [line], detect.parse_frame) == ["/usr/lib/python3/x.py:2 in distlib_g"]
    frames = ["/usr/lib/python3/x.py:2 in g", "/app/a.py:1 in f", "/app/a.py:1 in distlib_f", "<frozen os>:1 in h"]
    assert one(spark, frames, detect.is_library_frame) == [True, False, True, True]


def test_signatures(spark):
    cases = {
        "ValueError: bad\nValueError: bad": ["ValueError:bad"],
        "x.y.FooException:   " + "m" * 50: ["FooException:" + "m" * 40],
        "Error: none": [],
        "KeyError:\n  next line": ["KeyError:next line"],
        "error[E0308]: a\nerror[E0308]: b\nerror[E1]: c": ["error[E0308]", "error[E1]"],
        "src/a.cpp:1:2: error: bad  \nsrc/a.cc:1:2: error: no\nb.c:1:2: warning: w": ["gcc:bad"],
        "AError: " + "z" * 55 + "xBError: tail": ["AError:" + "z" * 40, "rror: tail"][:1],
        "DeprecationWarning: old": ["DeprecationWarning:old"],
    }
    assert one(spark, list(cases), signatures.extract_signatures) == list(cases.values())


def test_prompt_behind_much_white_space(spark):
    cases = {
        "go?" + " " * 1000: True, "x" * 300 + "\ngo:" + "\n" * 900: True, "x" * 118 + ":" + " " * 700: True,
        "x" * 121 + ">" + " " * 700: False, "x" * 500 + ">": False, "a\n" * 300 + "b>": True, " " * 900: False,
    }
    assert one(spark, list(cases), text.is_prompt) == list(cases.values())

"""Classification of prompts and answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions.text import PYWS, first_keyword, first_prefix, strip

# Prompt openings of the six families.
FAMILY_PREFIXES = (
    ("In Alice's Wonderland, the gravitational constant", "gravitational"),
    ("In Alice's Wonderland, a secret unit conversion", "unit_conversion"),
    ("In Alice's Wonderland, numbers are secretly converted", "numeral"),
    ("In Alice's Wonderland, secret encryption rules", "encrypt"),
    ("In Alice's Wonderland, a secret bit manipulation", "bitmanip"),
    ("In Alice's Wonderland, a secret set of transformation", "symbol"),
)
# Keywords of the seven generator domains, in order of precedence.
DOMAIN_KEYWORDS = (
    ("modular_arith", ("circular clock", "resets back to zero", "clock arithmetic", "modulo", "mod ")),
    ("list_ops", ("lists of numbers", "hidden structural rule", "structural rule", "list transformation", "rotate the list", "sort the list", "reverse the order of the list")),
    ("number_seq", ("magical sequence", "hidden pattern in a magical", "secret rule applied to its position", "numbers follow a hidden pattern")),
    ("roman", ("roman",)),
    ("binary_ops", ("bit manipulation", "binary", "8-bit", "bitwise", "bits")),
    ("cipher", ("encrypt", "cipher", "secret encryption", "decode", "decrypt", "shift", "substitut")),
    ("linear_eq", ("equation", "solve for", "algebra", "linear", "value of x")),
)
# Keywords of the four evaluation domains, in order of precedence.
EVAL_KEYWORDS = (
    ("binary", ("binary", "bit", "bitwise", "xor", " and ", " or ", "shift", "two's complement", "twos complement", "base-2", "base 2")),
    ("cipher", ("cipher", "encrypt", "decrypt", "caesar", "vigenere", "rot13", "rot ", "substitution", "plaintext", "ciphertext")),
    ("algebra", ("equation", "solve", "x =", "x=", "variable", "linear", "quadratic", "polynomial", "coefficient", "expression")),
    ("roman", ("roman", "numeral", "xiv", "xlii", "mcm", "lxxx", "mmxx", "dcc")),
)
# Answer formats that each generator domain gives, and the widths of its binary answers.
EXPECTED_FORMATS = (("binary_ops", ("binary",)), ("cipher", ("phrase", "word")), ("linear_eq", ("float", "int")), ("roman", ("int", "roman")), ("number_seq", ("int",)), ("list_ops", ("other",)), ("modular_arith", ("int",)))
BINARY_WIDTHS = (8,)
UNMATCHED = "__other__"


#: How a family's solver compares a prompt's beginning: as it stands, without white space before it, or without case too.
MATCHING = {"gravitational": "lstrip", "unit_conversion": "lstrip", "numeral": "lstrip", "encrypt": "strict", "bitmanip": "lower", "symbol": "strict"}


def family(prompt: Column) -> Column:
    """The family by the exact beginning of the prompt."""
    return first_prefix(prompt, FAMILY_PREFIXES, UNMATCHED)


def routed_family(prompt: Column) -> Column:
    """The family whose solver takes the prompt, each by its own rule of MATCHING."""
    bare = F.regexp_replace(prompt, f"^{PYWS}+", "")
    seen = {"strict": prompt, "lstrip": bare, "lower": F.lower(bare)}
    out = F.lit(UNMATCHED)
    for prefix, name in reversed(FAMILY_PREFIXES):
        rule = MATCHING[name]
        out = F.when(F.startswith(seen[rule], F.lit(prefix.lower() if rule == "lower" else prefix)), name).otherwise(out)
    return out


def domain(prompt: Column) -> Column:
    return first_keyword(prompt, DOMAIN_KEYWORDS, "uncovered")


def eval_domain(prompt: Column) -> Column:
    return first_keyword(prompt, EVAL_KEYWORDS, "other")


def answer_format(answer: Column) -> Column:
    """The first format that fits the whole of the stripped answer."""
    a = strip(answer)

    def fits(pattern: str) -> Column:
        return a.rlike(f"^(?:{pattern})\\z")

    return (
        F.when(a == "", "empty")
        .when((F.length(a) >= 2) & fits("[01]+"), "binary")
        .when(fits(r"(?U)-?\d+"), "int")
        .when(fits(r"(?U)-?\d+\.\d+"), "float")
        .when(fits("(?i)[IVXLCDM]+"), "roman")
        .when(fits(f"[A-Za-z]+(?:{PYWS}+[A-Za-z]+)+"), "phrase")
        .when(fits("[A-Za-z]+"), "word")
        .when(fits("[0-9A-Fa-f]+"), "hex")
        .otherwise("other")
    )


def template_signature(prompt: Column, head: int = 140) -> Column:
    """The prompt's opening with binary tokens, numbers and arrows masked."""
    s = F.lower(strip(prompt))
    s = F.regexp_replace(s, r"(?U)\b[01]{3,}\b", "<BIN>")
    s = F.regexp_replace(s, r"(?U)-?\d+(?:\.\d+)?", "<NUM>")
    s = F.regexp_replace(s, f"{PYWS}*(?:->|=>|\u2192|:){PYWS}*", " : ")
    return F.substring(F.regexp_replace(s, f"{PYWS}+", " "), 1, head)

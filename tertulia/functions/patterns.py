"""Java regular expressions used by the column functions.

Four rules hold throughout:

* character classes are spelt out (white space, word characters, decimal digits) instead of
  using ``\\s \\w \\d``, so that matches do not depend on the JDK's Unicode flags;
* a class lists its Latin-1 members one by one, which the JDK turns into one table look-up;
  chains of ranges and nested classes are several times slower and do not scale over the
  threads of an executor, so the text-wide patterns also come in a form for texts whose
  white space is blanks only;
* repeated groups are possessive wherever nothing after them could need the characters back:
  a possessive group runs as a loop, a greedy one recurses once per repetition and overflows
  the stack of a task on a message of some thousand words;
* a pattern that starts with a run of characters is anchored to the start of that run, which
  keeps the search linear on very long words.  ``\\G`` admits the place where the previous
  match ended.
"""

import string

from tertulia.fixed_values import EMOJI_RANGES, MAIL_MASK, NAME_MASK, NUMBER_MASK

_latin1 = [chr(i) for i in range(256)]
_WS_BITS = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x20\x85\xa0"
_WS_WIDE = r"[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
WS = f"[{_WS_BITS}]{_WS_WIDE}"  # for use inside a class
_WORD_BITS = "".join(c for c in _latin1 if c.isalnum()) + "_"
WORD = rf"[{_WORD_BITS}][\u0100-\x{{10FFFF}}&&[\p{{L}}\p{{N}}]]"  # for use inside a class
_s, _ns = f"[{WS}]", f"[^{WS}]"
_d = rf"[{string.digits}[\u0660-\x{{10FFFF}}&&\p{{Nd}}]]"
_ALNUM = string.ascii_letters + string.digits

NON_BLANK_RUN = f"{_ns}+"

# Placeholder for protected text (a private-use character; counted as a word character, so
# that a title glued to a protected span is not seen as the start of a word).
SLOT = "\ue000"

# --- line sanitising and message headers ---------------------------------------------
LINE_MARKS = "\u200e\u200f\u202f\u2068\u2069"  # characters, not a pattern
HYPHEN_PADDING = rf"(?:\G|(?<!{_s}))({_s}*-{_s}*)[~{WS}]+"
HEADER = (
    f"(?d)^{_s}*[\u200e\u200f]?"
    rf"({_d}{{1,2}}/{_d}{{1,2}}/{_d}{{2,4}},{_s}{_d}{{1,2}}:{_d}{{2}}(?::{_d}{{2}})?"
    rf"{_s}*(?:[aApP]\.?{_s}?[mM]\.?)?){_s}*-{_s}*(?:([^:]+):{_s}*)?(.*)$"
)

# --- redaction ------------------------------------------------------------------------
TEXT_MARKS = "\u200e\u200f"  # characters, not a pattern
_MASKS = "|".join(m.strip("[]") for m in (NAME_MASK, NUMBER_MASK, MAIL_MASK))
BRACKETED = (
    rf"(?:\G|(?<![{WORD}]))(?:[{WORD}]*+\[(?!{_MASKS})"
    rf"[^\]]++\][{WORD}]*+)++"
)
PHONE = rf"\+{_d}{{1,3}}(?:[().\-{WS}]*+{_d}++)++"
MAIL = rf"(?:\G|(?<![{_ALNUM}_.+\-]))[{_ALNUM}_.+\-]++@[{_ALNUM}\-]++\.[{_ALNUM}.\-]++"
_LATIN = f"[{string.ascii_letters}ÁÉÍÓÚáéíóúÑñ]"
TILDE_NAME = f"~{_s}*+{_LATIN}++(?:{_s}++{_LATIN}++)*+"
URL_SPAN = rf"https?://{_ns}+|www\.{_ns}+"

_TITLE = rf"(?=[DLIMP])(?<![{WORD}{SLOT}])(?:Dra?|Lic|Ing|Mtro?|Prof?)"
_CAP = "[A-ZÁÉÍÓÚÑ][a-záéíóúñ]++"
SPEAKER = (
    rf"{_TITLE}\.?{_s}+{_CAP}"
    rf"(?:{_s}++(?:de{_s}+la|del|de|la|{_CAP}))++{_s}*-"
)
SPEAKER_TOPIC = rf"(?d){_TITLE}\.?{_s}+.*?{_s}*-{_s}*(.*)"
SPEAKER_LEAD = rf"(?d)^((?s:.*?){_TITLE}\.?{_s}+.*?{_s}*-{_s}*)"
TITLE_PREFIX = rf"{_TITLE}\.{_s}*"

_NAME_WORD = r"(?:\p{Lu}\p{Ll}++)++"
NAME_CANDIDATE = rf"(?=\p{{Lu}})(?<![{WORD}{SLOT}]){_NAME_WORD}(?: ++{_NAME_WORD})++"

# --- text cleaning --------------------------------------------------------------------
_TLD = "(?iu:com|org|net|edu|gob|mx|es)"


def _web_address(ws: str) -> str:
    # An address always reaches to the end of its word, so one match per word is enough: the
    # whole word for host/path, else the part from the address on (group 1 is what stays).
    ns = f"[^{ws}]"
    return (
        rf"(?<!{ns})(?={ns}*[.:]{ns})"
        rf"(?:{ns}[^.{ws}]*+\.{ns}[^/{ws}]*+/{ns}+"
        rf"|({ns}*?)(?:(?iu:https?)://{ns}+|(?iu:www)\.{ns}+"
        rf"|(?<![{WORD}])(?<![{WORD}]\.)[{WORD}]++\."
        rf"(?:(?!{_TLD}(?![{WORD}]))[{WORD}]++\.)*+{_TLD}(?![{WORD}]){ns}*))"
    )


WEB_ADDRESS, WEB_ADDRESS_BLANKS = _web_address(WS), _web_address(" ")
# Tested after the table look-up, so only for characters that are about to be deleted.
SYMBOL = rf"[^{_ALNUM}áéíóúÁÉÍÓÚñÑ{_WS_BITS}](?<!{_WS_WIDE})"
SYMBOL_BLANKS = f"[^{_ALNUM}áéíóúÁÉÍÓÚñÑ ]"

# --- content --------------------------------------------------------------------------
LINK = rf'https?://[^{WS}<>"]+?(?=[A-Z¡!¿?,{WS}]|$|https?://)'
URL_SCHEME = r"https?://(?:www\.)?"
URL_HOST = "^[^/?#]*"


def _emoji_class() -> str:
    spans = (r.split("-") for r in EMOJI_RANGES.split())
    return "[" + "".join("-".join(rf"\x{{{p}}}" for p in span) for span in spans) + "]"


_UNIT = _emoji_class() + r"\x{FE0F}?[\x{1F3FB}-\x{1F3FF}]?"
# The look-ahead is a cheap test that ordinary letters fail before the long class is tried.
EMOJI = (
    r"[0123456789#*]\x{FE0F}?\x{20E3}"
    r"|(?=[\xA9\xAE[\x{203C}-\x{1FAFF}&&[\x{203C}-\x{303D}\x{3297}\x{3299}\x{1F004}-\x{1FAFF}]]])"
    r"(?:[\x{1F1E6}-\x{1F1FF}]{2}"
    r"|\x{1F3F4}[\x{E0020}-\x{E007E}]+\x{E007F}"
    rf"|{_UNIT}(?:\x{{200D}}{_UNIT})*+)"
)
PROTECTED = f"{URL_SPAN}|{EMOJI}|{SLOT}"

# --- timestamps -----------------------------------------------------------------------
_TIME = (
    rf"(?:,?(?:{_s}+|(?<=[0-9])[tT](?=[0-9])|(?<=,))({_d}{{1,2}}):({_d}{{2}})(?::({_d}{{2}}))?{_s}*"
    rf"(?:([aApP])\.?{_s}?[mM]\.?)?)?{_s}*$"
)
_SEP = r"([/.\-])"
CHAT_TIMESTAMP = rf"^{_s}*({_d}{{1,2}}){_SEP}({_d}{{1,2}})\2({_d}{{2,4}}){_TIME}"
YEAR_FIRST = rf"^{_s}*({_d}{{4}}){_SEP}({_d}{{1,2}})\2({_d}{{1,2}}){_TIME}"
_MONTH = r"([A-Za-z]{3,9})\.?"
MONTH_FIRST = rf"^{_s}*{_MONTH}{_s}+({_d}{{1,2}}),?{_s}+({_d}{{4}}){_TIME}"
DAY_MONTH = rf"^{_s}*({_d}{{1,2}})[{WS}\-]+{_MONTH}[{WS}\-]+({_d}{{4}}){_TIME}"
ISO_DATE_START = r"^\s*[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"

"""From bytes to text: which encoding a mapper document is in.

Offsets everywhere in this package count bytes of the UTF-8 form of the decoded
text, so the result of :func:`decoded` is UTF-8 bytes again.
"""

from __future__ import annotations

import codecs
import re

from quillmap.operators.messages import DECLARED as MISMATCH
from quillmap.operators.messages import NO_ENCODING

# Labels in XML declarations, by the standard names that are reported.
LABELS = {
    "UTF-8": "utf-8 utf8 unicode-1-1-utf-8 unicode11utf8 unicode20utf8 x-unicode20utf8",
    "EUC-KR": "euc-kr cseuckr csksc56011987 iso-ir-149 korean ks_c_5601-1987 ks_c_5601-1989 ksc5601 ksc_5601 windows-949",
    "Shift_JIS": "shift_jis shift-jis csshiftjis ms932 ms_kanji sjis windows-31j x-sjis",
    "EUC-JP": "euc-jp cseucpkdfmtjapanese x-euc-jp",
    "ISO-2022-JP": "iso-2022-jp csiso2022jp",
    "GBK": "gbk gb2312 chinese csgb2312 csiso58gb231280 gb_2312 gb_2312-80 iso-ir-58 x-gbk",
    "gb18030": "gb18030",
    "Big5": "big5 big5-hkscs cn-big5 csbig5 x-x-big5",
    "UTF-16LE": "utf-16 utf-16le csunicode iso-10646-ucs-2 ucs-2 unicode unicodefeff",
    "UTF-16BE": "utf-16be unicodefffe",
    "windows-1252": "windows-1252 ansi_x3.4-1968 ascii cp1252 cp819 csisolatin1 ibm819 iso-8859-1 iso-ir-100 iso8859-1 iso88591 iso_8859-1 iso_8859-1:1987 l1 latin1 us-ascii x-cp1252",
    "windows-1250": "windows-1250 cp1250 x-cp1250",
    "windows-1251": "windows-1251 cp1251 x-cp1251",
    "windows-1253": "windows-1253 cp1253 x-cp1253",
    "windows-1254": "windows-1254 cp1254 iso-8859-9 iso8859-9 iso_8859-9 l5 latin5 x-cp1254",
    "windows-1255": "windows-1255 cp1255 x-cp1255",
    "windows-1256": "windows-1256 cp1256 x-cp1256",
    "windows-1257": "windows-1257 cp1257 x-cp1257",
    "windows-1258": "windows-1258 cp1258 x-cp1258",
    "windows-874": "windows-874 dos-874 iso-8859-11 iso8859-11 tis-620",
    "ISO-8859-2": "iso-8859-2 iso8859-2 iso_8859-2 l2 latin2",
    "ISO-8859-3": "iso-8859-3 csisolatin3 iso-ir-109 iso8859-3 iso88593 iso_8859-3 iso_8859-3:1988 l3 latin3",
    "ISO-8859-4": "iso-8859-4 csisolatin4 iso-ir-110 iso8859-4 iso88594 iso_8859-4 iso_8859-4:1988 l4 latin4",
    "ISO-8859-5": "iso-8859-5 csisolatincyrillic cyrillic iso-ir-144 iso8859-5 iso88595 iso_8859-5 iso_8859-5:1988",
    "ISO-8859-6": "iso-8859-6 arabic asmo-708 csiso88596e csiso88596i csisolatinarabic ecma-114 iso-8859-6-e iso-8859-6-i iso-ir-127 iso8859-6 iso88596 iso_8859-6 iso_8859-6:1987",
    "ISO-8859-7": "iso-8859-7 csisolatingreek ecma-118 elot_928 greek greek8 iso-ir-126 iso8859-7 iso88597 iso_8859-7 iso_8859-7:1987 sun_eu_greek",
    "ISO-8859-8": "iso-8859-8 csiso88598e csisolatinhebrew hebrew iso-8859-8-e iso-ir-138 iso8859-8 iso88598 iso_8859-8 iso_8859-8:1988 visual",
    "ISO-8859-8-I": "iso-8859-8-i csiso88598i logical",
    "ISO-8859-10": "iso-8859-10 csisolatin6 iso-ir-157 iso8859-10 iso885910 l6 latin6",
    "ISO-8859-13": "iso-8859-13 iso8859-13 iso885913",
    "ISO-8859-14": "iso-8859-14 iso8859-14 iso885914",
    "ISO-8859-15": "iso-8859-15 csisolatin9 iso8859-15 iso885915 iso_8859-15 l9 latin9",
    "ISO-8859-16": "iso-8859-16",
    "KOI8-R": "koi8-r cskoi8r koi koi8 koi8_r",
    "KOI8-U": "koi8-u koi8-ru",
    "IBM866": "ibm866 866 cp866 csibm866",
    "macintosh": "macintosh csmacintosh mac x-mac-roman",
    "x-mac-cyrillic": "x-mac-cyrillic x-mac-ukrainian",
    "x-user-defined": "x-user-defined",
    "replacement": "replacement csiso2022kr hz-gb-2312 iso-2022-cn iso-2022-cn-ext iso-2022-kr",
}
#: Where Python's codec has another name or a narrower repertoire.
CODECS = {"EUC-KR": "cp949", "Shift_JIS": "cp932", "GBK": "gb18030", "Big5": "big5hkscs", "windows-874": "cp874", "ISO-8859-8-I": "iso-8859-8", "macintosh": "mac-roman", "x-mac-cyrillic": "mac-cyrillic"}
BY_LABEL = {label: name for name, labels in LABELS.items() for label in labels.split()}
KOREAN = {"CP949", "MS949", "XEUCKR", "UHC"}

DECLARED = re.compile(r"""encoding=(["'])""")


def _control(error: UnicodeError):
    """Single bytes 80-9F without a letter are the control of that number."""
    if not isinstance(error, UnicodeDecodeError):
        raise error
    bad = error.object[error.start : error.end]
    if not all(0x80 <= b <= 0x9F for b in bad):
        raise error
    return "".join(map(chr, bad)), error.end


codecs.register_error("quillmap.control", _control)


def resolved(label: str) -> str | None:
    """The standard name of a declared label, None if it is not known."""
    found = BY_LABEL.get(label.strip("\t\n\x0c\r ").lower())
    if found is None and re.sub(r"[^A-Za-z0-9]", "", label).upper() in KOREAN:
        return "EUC-KR"
    return found


def strict(data: bytes, name: str) -> str | None:
    """Decoded text, or None if any byte does not fit the encoding."""
    if name == "replacement":  # nothing but the empty document can be read
        return None if data else ""
    if name == "x-user-defined":  # bytes of the upper half are private letters
        return "".join(chr(b if b < 0x80 else 0xF700 + b) for b in data)
    try:
        return data.decode(CODECS.get(name, name), "quillmap.control" if name.startswith("windows") else "strict")
    except (UnicodeDecodeError, LookupError):
        return None


def declared(data: bytes) -> str | None:
    """The encoding that an XML declaration names in the first 200 bytes."""
    head = data[:200].decode("utf-8", "replace")
    found = DECLARED.search(head)
    if not found or not head.lstrip().startswith("<?xml"):
        return None
    # Only the first ``encoding=`` counts, with or without a quote after it.
    if head.find("encoding=") != found.start():
        return None
    end = head.find(found[1], found.end())
    return None if end < 0 else head[found.end() : end]


def decoded(data: bytes) -> tuple[bytes, str, list[dict]]:
    """(UTF-8 bytes, encoding's name, diagnostics) of a document's raw bytes.

    A UTF-16 mark is believed if the rest decodes; then UTF-8 is tried, then the
    declared encoding, then EUC-KR; if none fits, UTF-8 with replacements.
    """
    for mark, name in ((codecs.BOM_UTF16_LE, "UTF-16LE"), (codecs.BOM_UTF16_BE, "UTF-16BE")):
        if data.startswith(mark) and (text := strict(data[2:], name)) is not None:
            return text.encode(), name, []
    content = data.removeprefix(codecs.BOM_UTF8)
    said = declared(content)
    tries = ["UTF-8", resolved(said) if said else None, "EUC-KR"]
    for name in filter(None, tries):
        if (text := strict(content, name)) is not None:
            wrong = said is not None and resolved(said) != name
            told = MISMATCH.format(said, name, name)
            return text.encode(), name, [{"code": "encoding_mismatch", "span": None, "message": told}] if wrong else []
    return content.decode("utf-8", "replace").encode(), "UTF-8", [{"code": "encoding_undetectable", "span": None, "message": NO_ENCODING}]

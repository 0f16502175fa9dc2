"""Texts that queries plant in whole tables, so that lexicons meet words they know: inputs only, no results."""

from __future__ import annotations

import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTENCES = [
    "Arjuna killed Karna in battle.", "Then Drona said nothing of war.", "Bhishma vowed an oath before the king.", "Satyaki attacked Drona and fell upon the army near Kurukshetra with force.",
    "Duryodhana appointed general Karna at dawn.", "They appointed as leader the son of Surya.", "Kripa defended Drona and stood fast against the host.", "The king commanded Vidura to wait.",
    "Drona died in the field of Kurukshetra.", "See http://x.org/a.htm for war.", "Bhima slew Duhsasana, and the Kauravas fled from Bhima.", "The sage cursed Karna.", "Indra granted to Arjuna a boon.",
    "A warrior walked.", "Krishna and Arjuna engaged in battle with the Trigartas near Matsya.", "Yudhishthira was crowned at Hastinapur.", "The army retreated before the Kauravas of Anga.",
    "He was struck  down, beheaded and mourned.", "Über the warrior's war-horse, Émile.", "Salya was made commander by Duryodhana.", "Abhimanyu was surrounded by Drona, Kripa and Karna.", "It was a gift.",
    "Awarded prizes were not wars.", "And Sanjaya continued,--Karna is slain.", "Ghatotkacha rescued Bhima from the Rakshasas while Satyaki pursued them in Panchala.",
]

NAMES = [
    "Karna", "Bhishma", "Duryodhana", "Abhimanyu", "Drona", "Arjuna", "Bhima", "Krishna", "Draupadi", "Kunti", "Vidura", "Shalya", "Jayadratha",
    "Satyaki", "Virata", "Drupada", "Kripa", "Nakula", "Sahadeva", "Gandhari", "Uttara", "Subhadra", "Vasudeva", "Partha", "King Pandu",
]
TEMPLATES = [
    "Who killed {x}?", "Why did {x} support the host?", "What happened after {x}'s death?", "Who benefited from {x}'s death?", "Who cursed {x} before the last battle?", "How did {x} die?",
    "What was the result in the end for {x}?", "When was the coronation of {x}?", "Who slew {x} during the battle?", "Tell me of the first vow of {x}", "What led to the war of {x}, and where was it?", "Because of {x}-land the forest burned.",
]
#: alias, canonical, type beside the names themselves: several words, hyphens, a possessive, more than four words, a pronoun.
ALIASES = [
    ("host", "army", "GROUP"), ("last battle", "battle", "TIME"), ("battle", "battle", "TIME"), ("karna-land", "anga", "PLACE"), ("king pandu's", "pandu", "PERSON"), ("what was the result in the end", "ending", "LITERAL"), ("who", "somebody", "PERSON"), ("burn", "fire", "LITERAL"),
]
TEXTS = [
    "Arjuna", "the Partha", "Dhananjaya", "KARNA", "Radheya", "him", "12", "the", "of the", "having gone", "king of Anga", "army of the Kauravas", "city of elephants", "the sage", "evening", "Suyodhana", "Draupadi's",
    "panchali", "one", "x", "http karna", "a very long name that goes on and on and on and on beyond", "forest", "Krishna Vasudeva", "night watch", "making war",
]
NOTES = [
    "Table of Contents Index x\nkeep\nDownloaded from: y\nrest", "-the king of the ", "Index of things", "plain words here", "BOOK 1: ADI PARVA\nbody of one", "12\nTHE END\n\n\n\nlast", "downloaded from: z\nend", "A. b! C? D", "one\ntwo\n\n\nthree. Four", " the  host, ",
]
BOOK_TEXTS = [
    "front\nBOOK 1\n\nPart one of two\nADI PARVA\nSECTION I\nThe first body, long enough to be a narrative paragraph of its own.\nSECTION II\nsecond Body\nSECTION I\nagain in section two\nBOOK 2\nSABHA-PARVA\nno sections Here, only text.",
    "BOOK 3: VANA PARVA\nThe Chronicle, Book 3: Vana Parva: Section 4\nA tale of the forest, told at length so that it counts as narrative.\n\n\nIn section V they rest.\nsection V\nshort\nBOOK 3: VANA PARVA\nrepeated header\nBOOK 04: VIRATA PARVA CONTINUED\nSECTION X\nTales Untold\n",
    "no header at all",
    "BOOK 12\nSANTI PARVA\nSECTION 1\nSECTION 2\nIn the beginning there was a king who ruled long and well over all lands.\nSECTION 3\nx",
]


def pick(values: list[str], key: Column) -> Column:
    """The value of a row: key modulo their number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def quoted(text: str) -> str:
    """A text as a DuckDB literal."""
    return "E'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def listed(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def picked(values: list[str], key: str) -> str:
    """``pick`` as DuckDB SQL."""
    return f"list_extract({listed(values)}, ({key}) % {len(values)} + 1)"


def rows_of(values) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(quoted(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in values) + ")"


def pdf_of(pages: list[str]) -> bytes:
    """A small PDF file with a line of text on each page."""
    kids = " ".join(f"{10 + 2 * k} 0 R" for k in range(len(pages)))
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} >>".encode()}
    for k, text in enumerate(pages):
        shown = zlib.compress(f"BT /F1 12 Tf 20 700 Td ({text}) Tj ET".encode("latin-1"))
        objects[10 + 2 * k] = f"<< /Type /Page /Parent 2 0 R /Contents {11 + 2 * k} 0 R >>".encode()
        objects[11 + 2 * k] = b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(shown), shown)
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in objects.items()) + b"trailer\n<< /Root 1 0 R >>\n%%EOF"

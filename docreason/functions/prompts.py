"""Request texts: templates with ``{slot}`` placeholders filled by columns.

A template is split at plan time; the request text is one ``concat`` of
literal parts and columns, evaluated inside whole-stage codegen. The texts
below are this library's own defaults; callers pass their own templates
(for instance read from files) with the same slots.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SLOT = re.compile(r"\{([a-z_]+)\}")

PAGE_SYSTEM = ("Parse the page image into a JSON list of blocks with fields type, text, split and ref. "
               "Types: title, abstract, section_header, paragraph, equation, caption, figure, table, "
               "reference_header, reference_entry, unknown. Return JSON only.")
SEMANTIC_USER = "Figure labels:\n{figures}\n\nTable labels:\n{tables}\n\nClaims (JSON lines):\n{claims}"
CONTRACT_USER = ("Write causal mechanism contracts as a JSON list for the reasoning steps below.\n\n"
                 "Reasoning steps:\n{steps}")
QUESTIONS_USER = ("Write questions as JSON objects with category, contract_id, question and gold_answer.\n\n"
                  "TEXT:\n{raw_text}\n\nCONTRACTS:\n{contracts}")
ANSWER_USER = ("Answer each question as a JSON list of objects with question_id, answer and explanation.\n\n"
               "Questions:\n{questions}\n\nContext:\n{context}")
SCORE_USER = "Score the reasoning trace against the gold trace; reply with one number in [0, 1].\n\n{answer}"
DESIGN_USER = ("Propose candidates as CSV with header candidate_name,justification,feasibility_score,"
               "contract_parts, every field quoted.\n\nContract:\n{contract}")


def slots(template: str) -> list[str]:
    return SLOT.findall(template)


def render(template: str, **values) -> Column:
    """Fill ``{slot}`` placeholders with Columns (or column names)."""
    parts: list[Column] = []
    last = 0
    for m in SLOT.finditer(template):
        if m.start() > last:
            parts.append(F.lit(template[last:m.start()]))
        v = values[m.group(1)]
        parts.append(F.col(v) if isinstance(v, str) else v)
        last = m.end()
    if last < len(template):
        parts.append(F.lit(template[last:]))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def sql_render(template: str, **exprs: str) -> str:
    """The same template as a DuckDB string expression (oracle side)."""
    parts: list[str] = []
    last = 0
    for m in SLOT.finditer(template):
        if m.start() > last:
            parts.append(_sql_lit(template[last:m.start()]))
        parts.append(f"({exprs[m.group(1)]})")
        last = m.end()
    if last < len(template):
        parts.append(_sql_lit(template[last:]))
    return "(" + " || ".join(parts) + ")"


def _sql_lit(s: str) -> str:
    pieces = s.split("\n")
    return " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in pieces)

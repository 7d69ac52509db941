"""Search results and status as text, JSON or a navigation tree.

Rendering works on one request's collected results, which the candidate cap
keeps below a thousand rows.
"""

from __future__ import annotations

import json
import re
import unicodedata
from decimal import ROUND_HALF_UP, Decimal

NOTHING = "No matching documentation found."


def _fixed(value: float, places: int) -> str:
    step = Decimal(1).scaleb(-places)
    return str(Decimal(value).quantize(step, rounding=ROUND_HALF_UP))


def _label(score: float) -> str:
    text = _fixed(score, 3)
    return text.removeprefix("0") if score < 1 else text


def _title(text: str) -> str:
    folded = unicodedata.normalize("NFKC", text).lower()
    return "".join(c for c in folded if unicodedata.category(c)[0] in "LN")


def _natural(text: str) -> list:
    pieces = re.split(r"(\d+)", text)
    return [(0, int(p), "") if p.isdigit() else (1, 0, p.casefold()) for p in pieces if p]


def clean_heading(file_name: str, heading: list[str]) -> list[str]:
    kept = [
        part for i, part in enumerate(heading) if i == 0 or _title(part) != _title(heading[i - 1])
    ]
    stem = _title(re.sub(r"\.[^.]+$", "", file_name))
    return kept[1:] if kept and kept[0] and _title(kept[0]).endswith(stem) else kept


class _Node:
    def __init__(self, kind: str, label: str):
        self.kind, self.label = kind, label
        self.children: dict[tuple[str, str], _Node] = {}
        self.leaves: dict[tuple[int, int], float] = {}

    def under(self, kind: str, label: str) -> _Node:
        return self.children.setdefault((kind, label), _Node(kind, label))

    def scores(self) -> list[float]:
        nested = [score for child in self.children.values() for score in child.scores()]
        return list(self.leaves.values()) + nested

    def order(self) -> tuple:
        scores = self.scores()
        mean = sum(scores) / len(scores)
        return (-max(scores), -mean, -len(scores), _natural(self.label))

    def entries(self) -> list[tuple]:
        nodes = [((-max(n.scores()), 0, n.order()), n) for n in self.children.values()]
        leaves = [((-score, 1, lines), (lines, score)) for lines, score in self.leaves.items()]
        return [entry for _, entry in sorted(nodes + leaves, key=lambda pair: pair[0])]


def _lines(lines: tuple[int, int], score: float) -> str:
    first, last = lines
    return f"L{first if first == last else f'{first}-{last}'} {_label(score)}"


def _draw(entry, prefix: str, last: bool, out: list[str]) -> None:
    branch = prefix + ("└─ " if last else "├─ ")
    if isinstance(entry, tuple):
        out.append(branch + _lines(*entry))
        return
    label, tail = entry.label, entry
    while not tail.leaves and len(tail.children) == 1:
        (below,) = tail.children.values()
        joint = "/" if tail.kind == "directory" and below.kind != "heading" else " › "
        label, tail = label + joint + below.label, below
    if tail.kind == "directory":
        label += "/"
    if not tail.children and len(tail.leaves) == 1:
        out.append(f"{branch}{label} {_lines(*next(iter(tail.leaves.items())))}")
        return
    scores = entry.scores()
    out.append(f"{branch}{label} ×{len(scores)} {_label(sum(scores) / len(scores))}")
    entries = tail.entries()
    for number, nested in enumerate(entries, 1):
        _draw(nested, prefix + ("   " if last else "│  "), number == len(entries), out)


def tree(results: list[dict]) -> str:
    """Results by folder, file and heading, best branches first."""
    if not results:
        return NOTHING + "\n"
    split = [[p for p in r["path"].replace("\\", "/").split("/") if p] for r in results]
    folders = [segments[:-1] for segments in split]
    low, high = min(folders), max(folders)
    shared = 0
    while shared < min(len(low), len(high)) and low[shared] == high[shared]:
        shared += 1
    root = _Node("directory", "")
    for result, segments in zip(results, split, strict=True):
        node = root
        for name in segments[shared:-1]:
            node = node.under("directory", name)
        file_name = segments[-1] if segments else result["path"]
        node = node.under("file", file_name)
        for part in clean_heading(file_name, list(result["heading"])):
            node = node.under("heading", part)
        lines = (result["start_line"], result["end_line"])
        node.leaves[lines] = max(result["score"], node.leaves.get(lines, result["score"]))
    out = ["/".join(low[:shared]) + "/" if shared else "./"]
    nodes = sorted(root.children.values(), key=_Node.order)
    for number, node in enumerate(nodes, 1):
        _draw(node, "", number == len(nodes), out)
    return "\n".join(out) + "\n"


_SIGNALS = (
    ("vector_rank", "vector_rank", None),
    ("keyword_rank", "keyword_rank", None),
    ("vector_distance", "distance", 6),
    ("semantic_strength", "semantic", 4),
    ("lexical_strength", "lexical", 4),
    ("fusion_strength", "fusion", 4),
    ("confidence", "confidence", 4),
)


def _explanation(result: dict) -> dict:
    found = {
        name: result[column] if places is None else float(_fixed(result[column], places))
        for name, column, places in _SIGNALS
        if result.get(column) is not None
    }
    return {**found, "confidence_reason": result["reason"]}


def as_json(results: list[dict], explain: bool = False, facts: dict | None = None) -> str:
    listed = []
    for result in results:
        entry = {name: result[name] for name in ("path", "start_line", "end_line")}
        entry |= {"heading": list(result["heading"]), "score": result["score"]}
        if result.get("snippet"):
            entry["snippet"] = result["snippet"]
        if explain:
            entry["explanation"] = _explanation(result)
        listed.append(entry)
    body = {"results": listed, **({"diagnostics": facts} if facts else {})}
    return json.dumps(body, ensure_ascii=False, indent=2) + "\n"


def detailed(results: list[dict], explain: bool = False, facts: dict | None = None) -> str:
    """Plain text with line ranges; the tree when nothing more was asked for."""
    if not (explain or facts or any(result.get("snippet") for result in results)):
        return tree(results)
    blocks = []
    for result in results:
        place = f"{result['path']}:{result['start_line']}-{result['end_line']}"
        lines = [f"{_fixed(result['score'], 2)}  {place}"]
        if result["heading"]:
            lines.append("      " + " > ".join(result["heading"]))
        if result.get("snippet"):
            lines.append("      " + result["snippet"])
        if explain:
            signals = [f"{n} {_fixed(result[n], 2)}" for n in ("semantic", "lexical", "confidence")]
            signals.append(f"trust {result['reason']}")
            for route in ("vector", "keyword"):
                if result.get(f"{route}_rank"):
                    signals.append(f"{route} #{result[f'{route}_rank']}")
            lines.append("      signals: " + ", ".join(signals))
        blocks.append("\n".join(lines))
    text = "\n\n".join(blocks) or NOTHING
    if facts:
        text += "\n\n" + "; ".join(f"{name}: {value}" for name, value in facts.items())
    return text + "\n"


def status_text(status: dict) -> str:
    if not status["initialized"]:
        return f"No index in {status['root']}.\n"
    pending = ", ".join(f"{status[name]} {name}" for name in ("added", "modified", "deleted"))
    return (
        f"Project: {status['root']}\n"
        f"Model: {status.get('model') or 'unknown'}\n"
        f"Indexed: {status['documents']} documents, {status['chunks']} chunks\n"
        f"Pending: {pending}\n"
        f"Updated: {status.get('last_updated_at') or 'never'}\n"
    )

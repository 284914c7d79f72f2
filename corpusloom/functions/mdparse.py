"""One linear pass over a Markdown text: elements by tag, hierarchy violations, orphan rate, validity of the front matter.

Three readers of Markdown are followed, each in its own dialect: a converter to HTML with tables and fenced code (elements), a CommonMark
parser (headings and raw HTML blocks), and a splitter by lines (chunks under headings).  Plain Python over one text at a time, since block structure is
a state machine over lines; `markdown.profile` runs it in Arrow batches.
"""

from __future__ import annotations

import re
from bisect import bisect_right

try:
    import yaml
except ImportError:  # a pattern stands in, see front_matter_invalid
    yaml = LOADER = None
else:
    LOADER = getattr(yaml, "CSafeLoader", yaml.SafeLoader)

# Elements that count.
TAGS = ("table", "tr", "th", "td", "ul", "ol", "li", "h1", "h2", "h3", "h4", "h5", "h6", "b", "strong", "i", "em", "hr", "pre", "code", "blockquote", "math", "p", "a")
MOST_NESTED = 20

FENCE_OPEN = re.compile(r"(~{3,}|`{3,})[^`]*$")
HASHES = re.compile(r"(#{1,6})(.*?)#*$")
UNDERLINE = re.compile(r"(=+|-+) *$")
ITEM = re.compile(r" {0,3}(\d+\.|[*+-]) +(.*)")
INNER_ITEM = re.compile(r" {4,7}(?:\d+\.|[*+-]) +")
QUOTE = re.compile(r" {0,3}> ?(.*)")
DEFINITION = re.compile(r" {0,3}\[([^\]]+)\]: *\S+")
RAW_BLOCK = re.compile(r"<(?:!--|[?!]|/?(?:address|article|aside|blockquote|body|center|details|dialog|dd|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|iframe|li|link|main|math|menu|meta|nav|noscript|object|ol|p|pre|script|section|style|summary|table|tbody|td|tfoot|th|thead|title|tr|ul|video)\b)", re.I)
RAW_TAG = re.compile(r"<([a-zA-Z][a-zA-Z0-9]*)(?:\s[^<>]*)?/?>")
COMMENT = re.compile(r"<!--.*?-->", re.S)
AUTO_LINK = re.compile(r"<(?:https?://|ftp://|mailto:)[^\s<>]+>|<[^\s<>@]+@[^\s<>@]+\.[^\s<>@]+>")
TICKS = re.compile(r"`+")
LINK = re.compile(r"(?<!!)\[[^\[\]]*\](?:\([^()\n]*\)|\[([^\[\]]*)\])")
RUN = re.compile(r"\*+|_+")


def repeated_rule(line: str) -> bool:
    """A line of three or more of one of - _ * and blanks."""
    bare = line.strip(" ")
    return len(line) - len(line.lstrip(" ")) < 4 and bare[:1] in ("-", "_", "*") and bare[:1] != "" and bare.count(bare[0]) >= 3 and not bare.strip(bare[0] + " ") and "   " not in bare


class Elements:
    """Counts the elements of a text as a converter to HTML would make them."""

    def __init__(self, text: str):
        self.n = dict.fromkeys(TAGS, 0)
        lines = text.replace("\r\n", "\n").replace("\r", "\n").expandtabs(4).split("\n")
        lines = self._without_fences(lines)
        self.known = {m[1].lower() for m in map(DEFINITION.match, lines) if m}
        self.blocks(lines, 0)

    def _without_fences(self, lines: list[str]) -> list[str]:
        """Fenced code that is closed counts and gives way to a blank line."""
        ends: dict[str, list[int]] = {}
        for k, line in enumerate(lines):
            if line.startswith(("```", "~~~")):
                ends.setdefault(line.rstrip(" "), []).append(k)
        out, k = [], 0
        while k < len(lines):
            m = FENCE_OPEN.match(lines[k])
            if m:
                shut = ends.get(m[1], [])
                at = bisect_right(shut, k)
                if at < len(shut):
                    self.n["pre"] += 1
                    self.n["code"] += 1
                    out.append("")
                    k = shut[at] + 1
                    continue
            out.append(lines[k])
            k += 1
        return out

    def blocks(self, lines: list[str], depth: int, tight: bool = False) -> None:
        """`tight`: text stands in its list item without a paragraph."""
        block: list[str] = []
        last_list = [False, False]  # the block before is a list; its last item has text of its own
        for line in [*lines, ""]:
            if line.strip():
                block.append(line)
            elif block:
                self.block(block, depth, tight, last_list)
                block = []

    def block(self, lines: list[str], depth: int, tight: bool, last_list: list[bool]) -> None:
        """Lines without a blank one between them."""
        if depth > MOST_NESTED:
            return
        heads = [k for k, x in enumerate(lines) if x.startswith("#")]
        first = 0
        for k in heads:
            if k > first:
                self.without_heads(lines[first:k], depth, tight, last_list)
            m = HASHES.match(lines[k])
            self.n[f"h{len(m[1])}"] += 1
            self.inline(m[2])
            last_list[0], first = False, k + 1
        if first < len(lines):
            self.without_heads(lines[first:], depth, tight, last_list)

    def without_heads(self, lines: list[str], depth: int, tight: bool, last_list: list[bool]) -> None:
        rules = [k for k, x in enumerate(lines) if repeated_rule(x)] + [len(lines)]
        i = r = 0
        while i < len(lines):
            if lines[i].startswith("    "):
                k = next((k for k in range(i, len(lines)) if not lines[k].startswith("    ")), len(lines))
                if last_list[0]:
                    self.blocks([x[4:] for x in lines[i:k]], depth + 1)
                else:
                    self.n["pre"] += 1
                    self.n["code"] += 1
                i = k
                continue
            if i + 1 < len(lines) and UNDERLINE.fullmatch(lines[i + 1]):
                self.n["h1" if lines[i + 1].startswith("=") else "h2"] += 1
                self.inline(lines[i])
                last_list[0], i = False, i + 2
                continue
            while rules[r] < i:
                r += 1
            k = rules[r]
            if k > i:
                self.plain(lines[i:k], depth, tight, last_list)
            if k < len(lines):
                self.n["hr"] += 1
                last_list[0] = False
            i = k + 1

    def plain(self, lines: list[str], depth: int, tight: bool, last_list: list[bool]) -> None:
        if ITEM.match(lines[0]):
            self.items(lines, depth, last_list)
            return
        k = next((k for k, x in enumerate(lines) if QUOTE.match(x)), None)
        if k is not None:
            if k:
                self.plain(lines[:k], depth, tight, last_list)
            self.n["blockquote"] += 1
            self.blocks([m[1] if (m := QUOTE.match(x)) else x for x in lines[k:]], depth + 1)
            last_list[0] = False
            return
        last_list[0] = False
        if self.table(lines):
            return
        lines = [x for x in lines if not DEFINITION.match(x)]
        if not lines:
            return
        text = "\n".join(lines)
        if RAW_BLOCK.match(lines[0].lstrip(" ")):
            self.raw(text)
            return
        self.n["p"] += not tight
        self.inline(text)

    def items(self, lines: list[str], depth: int, last_list: list[bool]) -> None:
        kind = "ol" if ITEM.match(lines[0])[1][0].isdigit() else "ul"
        loose = last_list[0]
        if not loose:
            self.n[kind] += 1
        elif last_list[1]:
            self.n["p"] += 1  # the item before the blank line
        found: list[tuple[list[str], list[str]]] = []
        for line in lines:
            m = ITEM.match(line)
            if m:
                found.append(([m[2]], []))
            elif INNER_ITEM.match(line) or found[-1][1]:
                found[-1][1].append(line[4:] if line.startswith("    ") else line)
            else:
                found[-1][0].append(line.strip())
        for k, (own, inner) in enumerate(found):
            self.n["li"] += 1
            paragraph = loose and k == 0
            self.block([x for x in own if x.strip()], depth + 1, not paragraph, [False, False])
            if inner:
                self.block(inner, depth + 1, True, [False, False])
        last_list[0], last_list[1] = True, not (loose and len(found) == 1)

    def table(self, lines: list[str]) -> bool:
        def cells(row: str) -> list[str]:
            row = row.strip(" ")
            row = row[1:] if row.startswith("|") else row
            row = row[:-1] if row.endswith("|") and not row.endswith("\\|") else row
            return re.split(r"(?<!\\)\|", row)

        if len(lines) < 2 or "|" not in lines[0]:
            return False
        head, rule = cells(lines[0]), cells(lines[1])
        if len(head) != len(rule) or set("".join(rule)) - set("|:- ") or not all("-" in c for c in rule):
            return False
        if len(head) == 1 and not all(x.strip(" ").startswith("|") for x in lines[1:]):
            return False
        rows = max(len(lines) - 2, 1)
        self.n["table"] += 1
        self.n["tr"] += 1 + rows
        self.n["th"] += len(head)
        self.n["td"] += rows * len(head)
        self.inline("\n".join([lines[0], *lines[2:]]))
        return True

    def raw(self, text: str) -> str:
        """Counts HTML tags and gives the text without them."""
        if "<!--" in text:
            end = text.rfind("-->") + 3
            text = COMMENT.sub("", text[:end]) + text[end:] if end > 2 else text
        if "<" not in text:
            return text
        for m in RAW_TAG.finditer(text):
            if (tag := m[1].lower()) in self.n:
                self.n[tag] += 1
        return RAW_TAG.sub("", text)

    def inline(self, text: str) -> None:
        text = re.sub(r"\\([\\`*_{}\[\]()#+\-.!|<>])", "", text) if "\\" in text else text
        if "`" in text:
            text = self._without_code(text)
        if "<" in text:
            text, links = AUTO_LINK.subn("", text)
            self.n["a"] += links
            text = self.raw(text)
        if "[" in text:
            self.n["a"] += sum(1 for m in LINK.finditer(text) if m[1] is None or m[1].lower() in self.known)
            text = re.sub(r"\]\([^()\n]*\)", "]", text)
        if "*" in text or "_" in text:
            self._emphasis(text)

    def _without_code(self, text: str) -> str:
        runs = [(m.start(), m.end()) for m in TICKS.finditer(text)]
        ends: dict[int, list[int]] = {}
        for k, (a, b) in enumerate(runs):
            ends.setdefault(b - a, []).append(k)
        out, at, k = [], 0, 0
        while k < len(runs):
            a, b = runs[k]
            same = ends[b - a]
            j = bisect_right(same, k)
            if j < len(same):
                out.append(text[at:a])
                self.n["code"] += 1
                k = same[j]
                at = runs[k][1]
            k += 1
        return "".join([*out, text[at:]])

    def _emphasis(self, text: str) -> None:
        """Runs of one mark open and close: one is em, two strong, three both; underscores not inside words."""
        opened: list[tuple[str, int]] = []
        for m in RUN.finditer(text):
            a, b = m.span()
            key = (text[a], min(b - a, 3))
            before, after = text[a - 1] if a else " ", text[b] if b < len(text) else " "
            inner = key[0] == "_"
            may_close = not before.isspace() and not (inner and (after.isalnum() or after == "_"))
            may_open = not after.isspace() and not (inner and (before.isalnum() or before == "_"))
            if may_close and key in opened[-8:]:
                while opened.pop() != key:
                    pass
                self.n["em"] += key[1] != 2
                self.n["strong"] += key[1] != 1
            elif may_open and key not in opened[-8:]:
                opened.append(key)


# --- CommonMark: headings and raw HTML blocks --------------------------------------------------------------

ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]|$)")
SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
FENCE = re.compile(r" {0,3}(?:(`{3,})[^`]*|(~{3,}).*)$")
BULLET = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])( +|$)")
CODED_HTML = [
    (re.compile(r" {0,3}<(?:script|pre|style|textarea)(?:\s|>|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r" {0,3}<!--"), re.compile(r"-->")),
    (re.compile(r" {0,3}<\?"), re.compile(r"\?>")),
    (re.compile(r" {0,3}<![A-Z]"), re.compile(r">")),
    (re.compile(r" {0,3}<!\[CDATA\["), re.compile(r"\]\]>")),
]
BLOCK_HTML = re.compile(r" {0,3}</?(?:address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|frameset|h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul)(?:\s|/?>|$)", re.I)
ANY_HTML = re.compile(r" {0,3}(?:<[a-zA-Z][a-zA-Z0-9-]*(?:\s+[a-zA-Z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?>|</[a-zA-Z][a-zA-Z0-9-]*\s*>)\s*$")


def outline(lines: list[str], found: list, depth: int = 0) -> list:
    """Appends the levels of headings and the texts of raw HTML blocks in order."""
    if depth > MOST_NESTED:
        return found
    k, n, paragraph = 0, len(lines), False
    while k < n:
        line = lines[k].expandtabs(4)
        if not line.strip():
            paragraph, k = False, k + 1
            continue
        if line.startswith("    ") and not paragraph:
            k += 1
            continue
        if m := FENCE.match(line):
            mark = m[1] or m[2]
            k += 1
            while k < n and not (lines[k].strip().startswith(mark) and not lines[k].strip().strip(mark[0]) and len(lines[k]) - len(lines[k].lstrip(" ")) < 4):
                k += 1
            paragraph, k = False, k + 1
            continue
        if m := ATX.match(line):
            found.append(len(m[1]))
            paragraph, k = False, k + 1
            continue
        if paragraph and (m := SETEXT.match(line)):
            found.append(1 if m[1][0] == "=" else 2)
            paragraph, k = False, k + 1
            continue
        bare = line.strip()
        if line[:4].strip() and bare[0] in "-_*" and bare.count(bare[0]) >= 3 and not bare.strip(bare[0] + " \t"):
            paragraph, k = False, k + 1
            continue
        if bare[0] == "<":
            ends = next((end for start, end in CODED_HTML if start.match(line)), None)
            if ends or BLOCK_HTML.match(line) or (not paragraph and ANY_HTML.match(line)):
                first = k
                while k < n and not (ends.search(lines[k]) if ends else not lines[k].strip()):
                    k += 1
                k += 1 if ends else 0
                found.append("\n".join(lines[first:k]))
                paragraph = False
                continue
        if m := QUOTE.match(line):
            inner = []
            while k < n and (q := QUOTE.match(lines[k])):
                inner.append(q[1])
                k += 1
            outline(inner, found, depth + 1)
            paragraph = bool(inner[-1].strip())  # a line after it may go on with its paragraph
            while paragraph and k < n and lines[k].strip() and not (FENCE.match(lines[k]) or ATX.match(lines[k]) or BULLET.match(lines[k]) or lines[k].lstrip().startswith("<") or repeated_rule(lines[k])):
                k += 1
            paragraph = False
            continue
        m = BULLET.match(line)
        if m and not (paragraph and (not line[m.end() :].strip() or (m[2][0].isdigit() and m[2][:-1] != "1"))):
            width = m.end() if len(m[3]) in (1, 2, 3, 4) else m.end(2) + 1
            inner, k = [line[width:]], k + 1
            while k < n and (not lines[k].strip() or len(lines[k]) - len(lines[k].lstrip(" ")) >= width):
                inner.append(lines[k][width:])
                k += 1
            outline(inner, found, depth + 1)
            paragraph = False
            continue
        paragraph, k = True, k + 1
    return found


def violations(text: str) -> int:
    """Headings more than one level below the one before, and raw HTML blocks that hold no table anchor."""
    level, out = 0, 0
    for x in outline(text.replace("\r\n", "\n").replace("\r", "\n").split("\n"), []):
        if isinstance(x, str):
            out += "TABLE_ANCHOR" not in x
        else:
            out += level != 0 and x > level + 1
            level = x
    return out


# --- chunks and front matter -------------------------------------------------------------------------------


def orphans(text: str) -> float:
    """Share of chunks under no heading of levels 1 to 4; chunks in a row under the same headings are one.  No chunk: 1."""
    if text.lstrip().startswith("---"):
        parts = text.split("---", 2)
        text = parts[2].lstrip() if len(parts) == 3 else text
    path: list[tuple[int, str]] = []
    chunks: list[tuple] = []
    fence = ""
    for line in text.split("\n"):
        line = "".join(c for c in line.strip() if c.isprintable()) if not line.isprintable() else line.strip()
        if not fence:
            if line.startswith("```") and line.count("```") == 1:
                fence = "```"
            elif line.startswith("~~~"):
                fence = "~~~"
        elif line.startswith(fence):
            fence = ""
        hashes = len(line) - len(line.lstrip("#"))
        if not fence and 0 < hashes <= 4 and line[hashes : hashes + 1] in ("", " "):
            while path and path[-1][0] >= hashes:
                path.pop()
            path.append((hashes, line[hashes:].strip()))
        elif (line or fence) and (not chunks or chunks[-1] != tuple(path)):
            chunks.append(tuple(path))
    return sum(not c for c in chunks) / len(chunks) if chunks else 1.0


def front_matter_invalid(text: str) -> float:
    """0.0 if the text starts with a closed block that is a YAML mapping with a key, else 1.0."""
    text = text.strip()
    parts = text.split("---") if text.startswith("---") else []
    if len(parts) < 3:
        return 1.0
    if yaml is None:
        lines = [x for x in parts[1].split("\n") if x.strip()]
        return 0.0 if lines and all(re.match(r"[\w-][\w -]*:(?: [^:]*)?$", x) for x in lines) else 1.0
    try:
        found = yaml.load(parts[1], LOADER)  # a safe loader
    except Exception:  # whatever the loader refuses is no front matter
        return 1.0
    return 0.0 if isinstance(found, dict) and found else 1.0


def profile(text: str | None) -> tuple[list[int], int, float, float]:
    """(elements in the order of TAGS, violations, orphan rate, invalid front matter)"""
    text = text or ""
    return list(Elements(text).n.values()), violations(text), orphans(text), front_matter_invalid(text)

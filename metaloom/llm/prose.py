"""The prose of a document, without code, listings, logs and markup."""

from __future__ import annotations

import re

FENCE = re.compile(r"(?ms)^[ \t]*(```|~~~).*?(?:^[ \t]*\1[ \t]*$|\Z)")
FRONT = re.compile(r"(?s)\A\s*---[ \t]*\n.*?\n---[ \t]*(?:\n|\Z)")
TAGS = re.compile(r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|td|th|table|pre|section|article)\b[^>]*>")
INLINE = re.compile(r"`[^`\n]*`|https?://\S+|</?[A-Za-z][^>\n]*>|\{\{.*?\}\}|\{%.*?%\}|!\[[^\]]*\]\([^)]*\)")
MARKER = re.compile(r"^\s*(?:[-*+>•]|\d+[.)])\s+")
#: A line that is a heading, a table's row, a rule, a log entry or nothing but signs.
NO_PROSE = re.compile(
    r"""(?x) ^\s*(?:
        \# | \| | [-=_*]{3,}\s*$
      | \[? \d{4}-\d\d-\d\d[T\ ]\d\d:\d\d | \[? \d\d:\d\d:\d\d \b
      | (?: TRACE | DEBUG | INFO | WARN | WARNING | ERROR | FATAL | CRITICAL ) \b [\s:\]] | Traceback\ \( | \w*Exception:
      | [)({}\[\];,]+ \s* $ | [$>%]\ \w )
    """
)
#: A line of one name and one value.
SETTING = re.compile(r"^\s*[\w.-]+\s*[:=]\s*\S*\s*$")
#: Words that begin a statement of code. They begin sentences too, so the line's other words, its signs and its neighbours decide.
STATEMENT = re.compile(
    r"""(?xi) ^\s*(?: select | from | where | group\ by | order\ by | having | with\ \w+\ as | join | inner\ join | left\ join | right\ join | full\ join | cross\ join
      | union | merge\ into | insert\ into | update\ \w+\ set | delete\ from | create\ \w+ | alter\ \w+ | drop\ \w+ | when\ (?:not\ )?matched | limit\ \d
      | on\ \w+\.\w+ | and\ \w+\s*[=<>] | def\ \w+\( | class\ \w+ | import\ \w | return\ | for\ \w+\ in\ | if\ .*:$ | else:? | end ) (?:\b|(?<=\W))
    """
)
WHOLE_QUERY = re.compile(r"(?i)^\s*select\s+[\w\s,.]+\sfrom\s+[\w.]+\s*$")
#: Signs that sentences lack: operators, calls, qualified or joined names.
SIGN = re.compile(r"[=;{}<>|\\*_]|\w\(|[A-Za-z]\w+\.[A-Za-z]\w+|:\s*$")
#: Words that make sentences and occur in no statement.
SENTENCE_WORD = re.compile(
    r"(?i)\b(?:the|an|of|to|that|this|these|you|we|they|it|he|she|our|your|their|are|was|were|be|should|can|may|will|must"
    r"|der|die|das|den|dem|ein|eine|wir|sie|ist|sind|wird|el|la|los|las|un|una|del|que|se|es|son)\b"
)
SENTENCE_END = re.compile(r"[.!?…][\"'”’)]*\s*$")
WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’)]*\s+")
#: A line with fewer words than this that doesn't end like a sentence is a label.
LABEL_WORDS = 3


def doubtful(line: str) -> bool | None:
    """Whether a line is code: True, False, or None where its neighbours must tell."""
    ends = SENTENCE_END.search(line) is not None
    if SETTING.match(line):
        return False if ends and " " in line.strip() else None if line.lstrip()[:1].isupper() and line.rstrip()[-1:].isalpha() else True
    if not STATEMENT.match(line):
        return False
    line = INLINE.sub(" ", line)
    says = len(SENTENCE_WORD.findall(line))
    if SIGN.search(line):
        return not (says > 1 or (ends and says))
    return False if ends or says else True if WHOLE_QUERY.match(line) else None


def prose_lines(text: str) -> list[str]:
    """Lines that are no markup, log or code. A doubtful line is code if a line beside it is or may be."""
    lines = text.split("\n")
    if not (STATEMENT_ANY.search(text) or SETTING_ANY.search(text)):
        return [x for x in lines if x and not x.isspace() and not NO_PROSE.match(x)]
    marks = [None if not x or x.isspace() else doubtful(x) for x in lines]
    out = []
    for i, line in enumerate(lines):
        if not line or line.isspace() or NO_PROSE.match(line):
            continue
        code = marks[i]
        if code is None:
            code = any(0 <= j < len(lines) and lines[j] and not lines[j].isspace() and marks[j] is not False for j in (i - 1, i + 1))
        if not code:
            out.append(line)
    return out


STATEMENT_ANY = re.compile("(?m)" + STATEMENT.pattern, STATEMENT.flags)
SETTING_ANY = re.compile(r"(?m)^[ \t]*[\w.-]+[ \t]*[:=][ \t]*\S*[ \t]*$")


def sentences(text: str | None) -> list[list[str]]:
    """Sentences of the text's prose, each as its words in lower case; none if it has no prose.

    Not prose: fenced code, front matter, headings, tables, rules, logs, lists of settings,
    statements of code, lines full of signs, and labels (a word or two without a full stop).
    A line that begins like a statement ("from", "where", "end") is a sentence if its
    words or its end say so; a doubtful one is, unless it stands beside code.
    """
    if not text:
        return []
    text = text.replace("\r\n", "\n")
    if "---" in text or "```" in text or "~~~" in text:
        text = FENCE.sub("\n", FRONT.sub("\n", text))
    if "<" in text:
        text = TAGS.sub("\n", text)
    out = []
    for line in prose_lines(text):
        line = MARKER.sub("", line)
        if "`" in line or "://" in line or "<" in line or "{" in line or "![" in line:
            line = INLINE.sub(" ", line)
        if sum(map(line.count, "=;{}<>|\\")) > 0.05 * len(line):
            continue
        found = [words for part in SENTENCE.split(line) if (words := WORD.findall(part.lower()))]
        if sum(map(len, found)) >= LABEL_WORDS or (found and SENTENCE_END.search(line)):
            out += found
    return out

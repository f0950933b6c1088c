"""Small Python models shared by the property tests."""

import re


def changed_model(text, keep=20):
    """New-side numbers of added lines: restart at each header, ``-`` and ``+++`` do not count."""
    found, cur = [], None
    for line in text.splitlines():
        m = re.match(r"@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@", line)
        if m:
            cur = int(m[1])
        elif cur is not None and not line.startswith("+++"):
            is_add, is_del = line.startswith("+"), line.startswith("-")
            if is_add:
                found.append(cur)
            cur += 0 if is_del else 1
    return len(found), found[:keep]

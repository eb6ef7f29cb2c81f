"""Scripts of statements and their results: 'statement ok', 'statement error <regex>', 'query <types> [sort] [label]'."""

import re
from pathlib import Path

import pytest

from pathloom.session import Session


def shown(value, kind):
    if value is None:
        return "NULL"
    if kind == "R" and not hasattr(value, "isoformat"):
        return f"{value:.3f}"
    return str(value).lower() if isinstance(value, bool) else str(value) or "(empty)"


@pytest.mark.parametrize("path", sorted(Path(__file__).parent.glob("logic/*.test")), ids=lambda p: p.stem)
def test_script(spark, tmp_path, path):
    session, labels = Session(spark, str(tmp_path)), {}
    for block in re.split(r"\n\s*\n", path.read_text()):
        lines = [x for x in block.split("\n") if not x.startswith("#")]
        if not any(lines):
            continue
        head, *body = lines
        if head.startswith("statement error"):
            with pytest.raises(Exception, match=head.removeprefix("statement error ")):
                session.execute("\n".join(body)).collect()
        elif head == "statement ok":
            session.execute("\n".join(body)).collect()
        else:
            _, kinds, *rest = head.split()
            sql, _, want = "\n".join(body).partition("\n----")
            rows = [" ".join(shown(v, k) for v, k in zip(r, kinds, strict=True)) for r in session.execute(sql).collect()]
            if "rowsort" in rest:
                rows.sort()
            label = rest[1] if len(rest) > 1 else None
            if label in labels:
                assert rows == labels[label], sql
            else:
                assert rows == [x for x in want.split("\n") if x], sql
                labels[label or sql] = rows
    # what is stored is there for another session
    again = Session(spark, str(tmp_path)).execute("SHOW GRAPHS").collect()
    assert [tuple(r) for r in again] == [tuple(r) for r in session.execute("SHOW GRAPHS").collect()]

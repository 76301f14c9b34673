"""Answers for the REST sources in tests."""

import json


def jira(request, headers):
    assert headers["Authorization"].startswith("Basic ") and request["params"]["jql"] == "project = AB"
    return 200, json.dumps({"issues": [{"key": "AB-1"}, {"key": "AB-2"}]})


def notion(request, headers):
    parent = request["parent"]
    if "start_cursor" not in request.get("params", {}):
        return 200, json.dumps({"results": [{"id": f"{parent}-a"}], "has_more": True, "next_cursor": "c"})
    return (200, json.dumps({"results": [{"id": f"{parent}-b"}], "has_more": False})) if parent == "p1" else (500, "broken")


ISSUES = [
    {"key": f"{p}-{i}", "fields": {"project": {"key": p}, "status": {"name": ["Done", "done", "To Do"][i % 3]}, "assignee": {"displayName": "Kim"} if i % 2 else None, "summary": f"s{i}", "updated": f"2024-0{1 + i % 5}-1{i % 9}T10:00:30.000+0900"}}
    for p in ("AB", 'Q"X') for i in range(12)
]


def tracker(request, headers):
    """Answers the few forms of the language that the source writes, two issues a page; notes each query in the file that the address names."""
    import re
    from datetime import datetime
    from pathlib import Path

    jql, at = request["params"]["jql"], int(request["params"].get("nextPageToken", 0))
    if request["url"].startswith("file:"):
        with Path(request["url"].removeprefix("file:").partition("/rest/")[0]).open("a") as f:
            f.write(jql + "\n")
    found = ISSUES
    plain = lambda t: t.replace('\\"', '"').lower()
    for name, op, value in re.findall(r'(key|project|status|updated) (=|>=|<=|in|is not EMPTY) ?("(?:[^"\\]|\\.)*"|\([^)]*\))?', jql):
        def field(i, name=name):
            f = i["fields"]
            return {"key": i["key"], "project": f["project"]["key"], "status": f["status"]["name"], "updated": f["updated"]}[name]

        values = [plain(v) for v in re.findall(r'"((?:[^"\\]|\\.)*)"', value)]
        if op in ("=", "in"):
            found = [i for i in found if field(i).lower() in values]
        elif op != "is not EMPTY":
            when = datetime.strptime(values[0], "%Y/%m/%d %H:%M")
            found = [i for i in found if (datetime.fromisoformat(field(i)).replace(tzinfo=None) >= when) == (op == ">=")]
    page = {"issues": found[at : at + 2]}
    return 200, json.dumps(page | ({"nextPageToken": str(at + 2)} if at + 2 < len(found) else {}))


def wiki(request, headers):
    """Pages and times stand in the file that the address names; each page's blocks are asked for and noted."""
    from pathlib import Path

    path = Path(request["url"].removeprefix("file:").partition(".json")[0] + ".json")
    pages = json.loads(path.read_text())
    if request["url"].endswith("/search"):
        at, n = int(request["body"].get("start_cursor", 0)), request["body"]["page_size"]
        rows = sorted(({"object": "page", "id": i, "last_edited_time": t} for i, t in pages.items()), key=lambda p: p["last_edited_time"], reverse=True)
        return 200, json.dumps({"results": rows[at : at + n], "has_more": at + n < len(rows), "next_cursor": str(at + n)})
    with path.with_suffix(".asked").open("a") as f:
        f.write(request["parent"] + "\n")
    return 200, json.dumps({"results": [{"id": f"{request['parent']}-{k}", "at": pages[request["parent"]]} for k in range(2)], "has_more": False})

"""Analysis plans: what a test or chart needs, checked against a profile before anything is computed.

A withheld value fails exactly as one that does not exist.
"""

from __future__ import annotations

# The plan language.
TESTS = ("t", "mann_whitney", "kruskal_wallis", "ks", "chi_square")
MARKS = ("ecdf", "histogram", "box", "violin", "qq", "bar", "line")
AGGREGATES = ("mean", "median", "sum", "count")
MOST_GROUPS, MOST_BARS, LEAST_BINS, MOST_BINS, LEAST_GROUP, LEAST_GROUP_KS = 12, 30, 5, 100, 2, 3


def problem(code: str, message: str, fix: str, available: list[str] | None = None) -> dict:
    return {"code": code, "message": message, "fix": fix, "available": available or []}


def shown(column: dict) -> list[str]:
    return [g["value"] for g in column["groups"] or [] if not g["withheld"]]


def role_problem(profile: dict, name, field: str, role: str) -> list[dict]:
    legal = [c for c, x in profile.items() if x[role]]
    if not isinstance(name, str) or not name:
        return [problem("bad_plan_shape", f"{field} is required", f"name a {role} column", legal)]
    if name not in profile:
        return [problem("unknown_column", f'"{name}" is no column', f"name an existing {role} column", legal)]
    if not profile[name][role]:
        return [problem("not_temporal" if role == "temporal" else "wrong_column_type", f'"{name}" is not {role}', f"name a {role} column", legal)]
    return []


def group_problems(profile: dict, by: str, asked: list[str] | None, least: int) -> list[dict]:
    visible, sizes = shown(profile[by]), {g["value"]: g["n"] for g in profile[by]["groups"] or []}
    unknown = [v for v in asked or [] if v not in visible]
    if unknown:
        return [problem("unknown_group_value", f'"{v}" is no available group of "{by}"', "choose available groups", visible) for v in unknown]
    groups, out = asked or visible, []
    if len(groups) > MOST_GROUPS:
        out.append(problem("high_cardinality_group", f'"{by}" has {len(groups)} groups; at most {MOST_GROUPS} are compared', "name fewer groups", visible))
    small = [v for v in groups if sizes.get(v, 0) < least]
    if small:
        out.append(problem("group_too_small", f"under {least} rows: {', '.join(small)}", f"choose groups of at least {least} rows", [v for v in visible if sizes[v] >= least]))
    return out


def test_problems(plan: dict, profile: dict) -> list[dict]:
    test, by, groups = plan.get("test"), plan.get("groupBy"), plan.get("groups")
    if test not in TESTS:
        return [problem("bad_plan_shape", f'"{test}" is no test', "choose a test", list(TESTS))]
    out = role_problem(profile, plan.get("column"), "column", "categorical" if test == "chi_square" else "numeric") + role_problem(profile, by, "groupBy", "categorical")
    if out:
        return out
    visible = shown(profile[by])
    if test in ("t", "mann_whitney", "ks") and len(groups if groups is not None else visible) != 2:
        out.append(problem("wrong_group_count", f"{test} compares two groups", "name two groups", visible))
    if test == "kruskal_wallis" and groups is not None and len(groups) < 2:
        out.append(problem("wrong_group_count", "kruskal_wallis compares two or more groups", "name more groups", visible))
    if test == "chi_square" and groups is not None:
        out.append(problem("bad_plan_shape", "chi_square uses all levels", "leave groups out"))
    least = {"ks": LEAST_GROUP_KS, "chi_square": 0}.get(test, LEAST_GROUP)
    return out + group_problems(profile, by, None if test == "chi_square" else groups, least)


def chart_problems(plan: dict, profile: dict) -> list[dict]:
    mark, by = plan.get("mark"), plan.get("groupBy")
    if mark not in MARKS:
        return [problem("bad_plan_shape", f'"{mark}" is no chart', "choose a mark", list(MARKS))]
    out = role_problem(profile, plan.get("column"), "column", "categorical" if mark == "bar" else "numeric")
    if by is not None:
        out += role_problem(profile, by, "groupBy", "categorical")
    if mark == "line":
        out += role_problem(profile, plan.get("x"), "x", "temporal")
    for field, code, marks in (("x", "bad_plan_shape", ("line",)), ("bins", "bad_plan_shape", ("histogram",)), ("orientation", "bad_orientation", ("bar",)), ("agg", "bad_plan_shape", ("bar", "line"))):
        if plan.get(field) is not None and mark not in marks:
            out.append(problem(code, f"{field} does not belong to a {mark} chart", f"leave {field} out"))
    bins = plan.get("bins")
    if mark == "histogram" and bins is not None and (not isinstance(bins, int) or isinstance(bins, bool) or not LEAST_BINS <= bins <= MOST_BINS):
        out.append(problem("bad_bins", f"bins must be a whole number from {LEAST_BINS} to {MOST_BINS}", "change or leave out bins"))
    if out:
        return out
    if mark == "bar":
        if len(shown(profile[plan["column"]])) > MOST_BARS:
            out.append(problem("high_cardinality_group", f"a bar chart has at most {MOST_BARS} bars", "choose another column"))
        if plan.get("agg") not in (None, "count"):
            out.append(problem("bad_plan_shape", "bars count rows", "leave agg out"))
    return out + (group_problems(profile, by, None, 0) if by is not None else [])


def problems(plan, profile: dict) -> list[dict]:
    """What is wrong with a plan; an empty list if it can run."""
    if not isinstance(plan, dict) or plan.get("kind") not in ("test", "chart"):
        return [problem("bad_plan_shape", 'a plan has the kind "test" or "chart"', "set kind", ["test", "chart"])]
    return (test_problems if plan["kind"] == "test" else chart_problems)(plan, profile)


def told(found: list[dict]) -> str:
    return "\n".join(["The plan was rejected:", *[f"[{p['code']}] {p['message']}; {p['fix']}" + (f" (available: {', '.join(p['available'])})" if p["available"] else "") for p in found]])

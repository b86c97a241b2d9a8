"""What a client may ask: routes over stored runs, each checked against raw data when it is registered and when it
answers, and a small server for them. Routes return plain dicts, so any other server can carry them."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, urlparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.operators.govern import BLOCKED, GuardError, attribution_text, calibration_flag, exposable, render_report, report_provenance
from terrane.params import Params


class NotFound(KeyError):
    """No such run or route."""


@dataclass(frozen=True)
class Stored:
    """A run that may be shown: zones (zone, price, base_price) of its horizon, and where its numbers come from."""

    city: str
    scenario: str
    horizon: int
    zones: DataFrame
    provenance: dict
    headline: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()


class RunStore:
    """Runs by city, scenario and horizon."""

    def __init__(self, runs: list[Stored]) -> None:
        self.runs = {(r.city, r.scenario, r.horizon): r for r in runs}

    def get(self, city: str, scenario: str, horizon: int) -> Stored:
        if (city, scenario, horizon) not in self.runs:
            raise NotFound(f"no run of {city}, {scenario}, {horizon}")
        return self.runs[city, scenario, horizon]

    def any(self, city: str) -> Stored:
        found = [r for k, r in sorted(self.runs.items()) if k[0] == city]
        if not found:
            raise NotFound(f"no run of {city}")
        return found[0]


def names(value: object) -> set[str]:
    """All keys in an answer, at any depth."""
    if isinstance(value, dict):
        return set(value) | {n for v in value.values() for n in names(v)}
    return {n for v in value for n in names(v)} if isinstance(value, (list, tuple)) else set()


class Router:
    """Routes by method and path; a route says which fields it answers with, and none may be raw data."""

    def __init__(self, blocked: tuple[str, ...] = BLOCKED) -> None:
        self.blocked, self.routes = blocked, []

    def _check(self, fields: set[str], what: str) -> None:
        bad = sorted(n for n in fields if any(re.search(b, n) for b in self.blocked))
        if bad:
            raise GuardError(f"{what} would show raw data: {bad}")

    def add(self, method: str, path: str, fields: tuple[str, ...], handler: Callable[..., dict]) -> None:
        if not fields:
            raise GuardError(f"{method} {path} does not say what it answers with")
        self._check(set(fields), f"{method} {path}")
        pattern = re.compile("^" + re.sub(r"\{(\w+)\}", r"(?P<\1>[^/]+)", path) + "$")
        self.routes.append((method, pattern, set(fields), handler))

    def answer(self, method: str, path: str, **given: object) -> dict:
        """A route's answer, checked once more, with its declared fields at the top level alone."""
        for m, pattern, fields, handler in self.routes:
            found = pattern.match(path)
            if m == method and found:
                out = handler(**found.groupdict(), **given)
                self._check(names(out), f"{method} {path}")
                odd = set(out) - fields
                if odd:
                    raise GuardError(f"{method} {path} answers with undeclared {sorted(odd)}")
                return out
        raise NotFound(f"no route {method} {path}")


def outlook(run: Stored, top: int | None = None) -> list[dict]:
    """Change in per cent and rank of each zone, best first; ties by name. A city's zones, some hundreds of rows."""
    change = F.when(F.col("base_price") > 0, (F.col("price") / F.when(F.col("base_price") > 0, F.col("base_price")) - 1) * 100)
    rows = exposable(run.zones).select("zone", F.round(change, 2).alias("change_pct")).orderBy(F.desc_nulls_last("change_pct"), "zone")
    got = (rows.limit(top) if top else rows).collect()
    return [{"zone": r.zone, "change_pct": r.change_pct, "rank": i} for i, r in enumerate(got, 1)]


def create_router(runs: RunStore, p: Params, sources: dict[str, dict], version: str, policy: str = "derived works only", level: str = "class_defaults", narrator: Callable[[Stored], list[tuple[str, str]]] | None = None) -> Router:
    """The routes: health, attributions, about, policy, provenance, outlook, scenarios, reports."""
    router = Router()

    def block(run: Stored) -> dict:
        return report_provenance(p, run.provenance, list(run.headline), run.city, level)

    def about(city: str | None = None) -> dict:
        run = runs.any(city) if city else None
        return {"version": version, "parameters": p.manifest()["leaves"], "attribution": attribution_text(sources), "flag": calibration_flag(block(run)) if run else None}

    def scenario(city: str, scenario: str, horizon: int, against: str = "base") -> dict:
        run, base = runs.get(city, scenario, int(horizon)), runs.get(city, against, int(horizon))
        left = exposable(run.zones).select("zone", F.col("price").alias("_a"))
        rows = left.join(exposable(base.zones).select("zone", F.col("price").alias("_b")), "zone")
        diff = F.when(F.col("_b") > 0, F.round((F.col("_a") / F.when(F.col("_b") > 0, F.col("_b")) - 1) * 100, 2))
        return {"scenario": scenario, "against": against, "zones": [{"zone": r.zone, "difference_pct": r.d} for r in rows.select("zone", diff.alias("d")).orderBy("zone").collect()]}

    def report(city: str, scenario: str, horizon: int, sections: list | None = None) -> dict:
        run = runs.get(city, scenario, int(horizon))
        zones = outlook(run)
        data = {"zones": {str(z["zone"]): z for z in zones}, "n_zones": len(zones)}
        said = [tuple(s) for s in sections or []] or (narrator(run) if narrator else [("Outlook", f"The report covers {len(zones)} zones [n_zones].")])
        here = block(run)
        text = render_report(f"{city} {scenario} {horizon}", said, data, {k: v for k, v in here.items() if k != "tags"})
        credit = attribution_text(sources, list(run.sources)) if run.sources else attribution_text(sources)
        return {"title": f"{city} {scenario} {horizon}", "text": text, "attribution": credit, "provenance": here, "flag": calibration_flag(here)}

    router.add("GET", "/health", ("status", "version"), lambda: {"status": "ok", "version": version})
    router.add("GET", "/attributions", ("sources", "text"), lambda: {"sources": [{"source": k, "licence": str(x.get("licence", "")), "attribution": str(x.get("attribution", ""))} for k, x in sorted(sources.items())], "text": attribution_text(sources)})
    router.add("GET", "/about", ("version", "parameters", "attribution", "flag"), about)
    router.add("GET", "/policy/exposure", ("policy", "blocked"), lambda: {"policy": policy, "blocked": list(router.blocked)})
    router.add("GET", "/cities/{city}/provenance", ("provenance", "flag"), lambda city: {"provenance": (here := block(runs.any(city))), "flag": calibration_flag(here)})
    router.add("GET", "/cities/{city}/outlook", ("city", "scenario", "horizon", "zones", "flag"), lambda city, scenario, horizon: {"city": city, "scenario": scenario, "horizon": int(horizon), "zones": outlook(run := runs.get(city, scenario, int(horizon))), "flag": calibration_flag(block(run))})
    router.add("POST", "/cities/{city}/scenarios", ("scenario", "against", "zones"), scenario)
    router.add("POST", "/cities/{city}/reports", ("title", "text", "attribution", "provenance", "flag"), report)
    return router


def serve(router: Router, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server for the routes, not started; raw data gives 451, an unknown run 404, a wrong request 400."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, method: str) -> None:
            url = urlparse(self.path)
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
                code, out = 200, router.answer(method, url.path, **dict(parse_qsl(url.query)), **body)
            except NotFound as e:
                code, out = 404, {"error": str(e)}
            except GuardError as e:
                code, out = 451, {"error": str(e)}
            except (TypeError, ValueError) as e:
                code, out = 400, {"error": str(e)}
            data = json.dumps(out).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:  # noqa: N802
            self._answer("GET")

        def do_POST(self) -> None:  # noqa: N802
            self._answer("POST")

        def log_message(self, *said: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)

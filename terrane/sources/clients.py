"""Clients of outside services, used at ingest alone: archives over HTTP with a cache, a routing table service and an
imagery catalogue. How a URL is opened is a parameter, so nothing here needs a network to be tested."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.parse
import urllib.request
from collections.abc import Callable
from pathlib import PurePosixPath

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from terrane.sources.readers import FileReader

Opener = Callable[[str, bytes | None], bytes]


class ClientError(RuntimeError):
    """A service did not answer as it should."""


def open_url(url: str, body: bytes | None = None, timeout: float = 60.0) -> bytes:
    request = urllib.request.Request(url, data=body, headers={"Content-Type": "application/json"} if body else {})
    with urllib.request.urlopen(request, timeout=timeout) as got:  # noqa: S310
        return got.read()


class HttpArchiveReader(FileReader):
    """Files by name from their URLs: fetched once into a folder that Spark can read, named by the URL's hash.

    Between two requests at least min_interval seconds pass, as a source's terms ask.
    """

    def __init__(self, spark: SparkSession, urls: dict[str, str], cache: str, schemas: dict[str, str] | None = None, min_interval: float = 1.0, opener: Opener = open_url, clock=time.monotonic, sleep=time.sleep) -> None:
        super().__init__(spark, cache, schemas)
        self.urls, self.min_interval, self.opener, self.clock, self.sleep, self.last = dict(urls), min_interval, opener, clock, sleep, None

    def _cached(self, name: str) -> str:
        url = self.urls.get(name, name)
        return hashlib.sha256(url.encode()).hexdigest() + PurePosixPath(urllib.parse.urlparse(url).path).suffix

    def exists(self, name: str) -> bool:
        return name in self.urls or super().exists(self._cached(name))

    def fetch(self, name: str, force: bool = False) -> str:
        """Name of the cached file, fetched if it is not there."""
        target = self._cached(name)
        if super().exists(target) and not force:
            return target
        if name not in self.urls:
            raise ClientError(f"no URL for {name}")
        if self.last is not None and (left := self.min_interval - (self.clock() - self.last)) > 0:
            self.sleep(left)
        data = self.opener(self.urls[name], None)
        self.last = self.clock()
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{target}")
        out = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(data))
        out.close()
        return target

    def table(self, name: str) -> DataFrame:
        target = self.fetch(name)
        if name in self.schemas:
            self.schemas[target] = self.schemas[name]
        return super().table(target)


class TableService:
    """A routing service's table of minutes, asked in blocks; a pair without a way is infinite."""

    def __init__(self, endpoints: str | dict[str, str], chunk: int = 500, opener: Opener = open_url) -> None:
        self.endpoints, self.chunk, self.opener = endpoints, chunk, opener

    def _base(self, profile: str) -> str:
        base = self.endpoints if isinstance(self.endpoints, str) else self.endpoints.get(profile)
        if base is None:
            raise ClientError(f"no endpoint for {profile}")
        return base.rstrip("/")

    def _block(self, here: np.ndarray, there: np.ndarray, profile: str, what: str) -> np.ndarray:
        points = ";".join(f"{lon},{lat}" for lat, lon in (*here, *there))
        query = urllib.parse.urlencode({"sources": ";".join(map(str, range(len(here)))), "destinations": ";".join(str(len(here) + j) for j in range(len(there))), "annotations": what}, safe=";,")
        said = json.loads(self.opener(f"{self._base(profile)}/table/v1/{profile}/{points}?{query}", None))
        if said.get("code") != "Ok":
            raise ClientError(f"table service: {said.get('code')} {said.get('message')}")
        return np.array([[np.inf if v is None else float(v) for v in row] for row in said["durations" if what == "duration" else "distances"]])

    def matrix(self, origins: np.ndarray, destinations: np.ndarray, profile: str, what: str = "duration") -> np.ndarray:
        """Minutes (or metres, of what='distance') from each (lat, lon) to each."""
        out = np.full((len(origins), len(destinations)), np.inf)
        for a in range(0, len(origins), self.chunk):
            for b in range(0, len(destinations), self.chunk):
                out[a : a + self.chunk, b : b + self.chunk] = self._block(origins[a : a + self.chunk], destinations[b : b + self.chunk], profile, what)
        return out / 60 if what == "duration" else out

    def backend(self) -> Callable[[DataFrame, DataFrame, str], DataFrame]:
        """For networks.precompute: executors ask the service, a chunk of origins at a time. origins (origin, lat, lon);
        destinations (destination, lat, lon) are the capped set and go to every task. Unreachable pairs are null."""

        def pairs(origins: DataFrame, destinations: DataFrame, mode: str) -> DataFrame:
            to = destinations.select("destination", "lat", "lon").toPandas()  # access.max_destinations rows

            def ask(batches):
                for part in batches:
                    for at in range(0, len(part), self.chunk):
                        some = part.iloc[at : at + self.chunk]
                        got = self.matrix(some[["lat", "lon"]].to_numpy(float), to[["lat", "lon"]].to_numpy(float), mode)
                        made = some[["origin"]].merge(to[["destination"]], how="cross").assign(minutes=got.ravel())
                        yield made.assign(minutes=made["minutes"].where(np.isfinite(made["minutes"]), None).astype(float))

            kinds = dict(origins.dtypes) | dict(destinations.dtypes)
            return origins.select("origin", "lat", "lon").mapInPandas(ask, f"origin {kinds['origin']}, destination {kinds['destination']}, minutes double")

        return pairs


class ImageryCatalogue:
    """Searches a catalogue of scenes; pixels are read by whoever holds a raster reader and come as a long table."""

    def __init__(self, endpoint: str, collection: str, opener: Opener = open_url) -> None:
        self.endpoint, self.collection, self.opener = endpoint.rstrip("/"), collection, opener

    def scenes(self, spark: SparkSession, bounds: tuple[float, float, float, float], start: str, end: str, max_cloud: float, assets: tuple[str, ...], page: int = 100) -> DataFrame:
        """(scene, time, cloud, assets) of scenes in a box and period that are clear enough; pages are followed."""
        body = {"collections": [self.collection], "bbox": list(bounds), "datetime": f"{start}/{end}", "limit": page, "query": {"eo:cloud_cover": {"lt": max_cloud}}}
        url, rows = f"{self.endpoint}/search", []
        while url:
            said = json.loads(self.opener(url, json.dumps(body).encode()))
            for item in said.get("features", []):
                cloud = item["properties"].get("eo:cloud_cover")
                if cloud is None or cloud < max_cloud:
                    rows.append((item["id"], item["properties"]["datetime"], None if cloud is None else float(cloud), {a: item["assets"][a]["href"] for a in assets if a in item["assets"]}))
            after = next((x for x in said.get("links", []) if x.get("rel") == "next"), None)
            url, body = (after["href"], after.get("body", body)) if after else (None, body)
        return spark.createDataFrame(rows, "scene string, time string, cloud double, assets map<string,string>")

"""Projects, versions and deployments of models, kept as JSON and model files in one folder.

A version is written once under a new number and never changed; what is deployed is a small
file of its own. Any folder that the cluster's file systems know will do.
"""

from __future__ import annotations

import json
import time

from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession

from vectrill.operators.learn import from_json, to_json


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _list(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _read(self, path: str):
        rows = self.spark.read.option("wholetext", True).text(path).collect()
        return json.loads(rows[0][0])

    def _write(self, path: str, value) -> None:
        fs, p = self._fs(path)
        out = fs.create(p, True)
        out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        out.close()

    def create_project(self, name: str, kind: str = "classification", description: str = "") -> None:
        if self._exists(f"{self.root}/{name}/project.json"):
            raise ValueError(f"project {name} exists")
        self._write(f"{self.root}/{name}/project.json", {"name": name, "kind": kind, "description": description, "created_at": time.time()})

    def delete_project(self, name: str) -> bool:
        fs, p = self._fs(f"{self.root}/{name}")
        return fs.delete(p, True)

    def projects(self) -> list[dict]:
        return [self.project(n) for n in self._list(self.root) if self._exists(f"{self.root}/{n}/project.json")]

    def project(self, name: str) -> dict:
        info = self._read(f"{self.root}/{name}/project.json")
        versions = self.versions(name)
        return info | {"versions": len(versions), "latest": max(versions, default=None), "deployed": self.deployed(name)}

    def versions(self, name: str) -> list[int]:
        return sorted(int(v[1:]) for v in self._list(f"{self.root}/{name}") if v[0] == "v" and v[1:].isdigit())

    def save(self, name: str, model, algorithm: str, parameters: dict | None = None, metrics: dict | None = None) -> int:
        """Stores a model under the next version number."""
        v = max(self.versions(name), default=0) + 1
        at = f"{self.root}/{name}/v{v}"
        if hasattr(model, "write"):
            model.write().save(f"{at}/model")
            kind = f"{type(model).__module__}.{type(model).__name__}"
        else:
            self._write(f"{at}/model.json", json.loads(to_json(model)))
            kind = "json"
        self._write(f"{at}/info.json", {"version": v, "algorithm": algorithm, "kind": kind, "parameters": parameters or {}, "metrics": metrics or {}, "created_at": time.time()})
        return v

    def info(self, name: str, version: int) -> dict:
        return self._read(f"{self.root}/{name}/v{version}/info.json")

    def load(self, name: str, version: int | None = None):
        """The model of a version; the deployed one by default, else the latest."""
        version = version or self.deployed(name) or max(self.versions(name))
        at = f"{self.root}/{name}/v{version}"
        if self.info(name, version)["kind"] == "json":
            return from_json(json.dumps(self._read(f"{at}/model.json")))
        return DefaultParamsReader.loadParamsInstance(f"{at}/model", self.spark)

    def deploy(self, name: str, version: int | None = None) -> int:
        version = version or max(self.versions(name))
        if version not in self.versions(name):
            raise ValueError(f"{name} has no version {version}")
        self._write(f"{self.root}/{name}/deployed.json", {"version": version, "deployed_at": time.time()})
        return version

    def deployed(self, name: str) -> int | None:
        at = f"{self.root}/{name}/deployed.json"
        return self._read(at)["version"] if self._exists(at) else None

    def models(self) -> DataFrame:
        """One row a version: project, version, algorithm, deployed, metrics as JSON."""
        rows = []
        for p in self.projects():
            for v in self.versions(p["name"]):
                i = self.info(p["name"], v)
                rows.append((p["name"], v, i["algorithm"], p["deployed"] == v, json.dumps(i["metrics"], sort_keys=True)))
        return self.spark.createDataFrame(rows, "project string, version int, algorithm string, deployed boolean, metrics string")

    def drop(self, name: str, version: int) -> bool:
        fs, p = self._fs(f"{self.root}/{name}/v{version}")
        return fs.delete(p, True)

"""Connection settings of an object store, from TOML, as Spark configuration."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    bucket: str
    region: str = "us-west-2"
    endpoint: str | None = None
    access_key_id: str | None = None
    secret_access_key: str | None = None

    @classmethod
    def parse(cls, text: str) -> Settings:
        """Unknown keys are an error, and so is a missing ``bucket``."""
        return cls(**tomllib.loads(text))

    @property
    def root(self) -> str:
        return f"s3a://{self.bucket}"

    def spark_conf(self) -> dict[str, str]:
        """Configuration for this bucket alone; without keys the store's default credentials are used."""
        base = f"spark.hadoop.fs.s3a.bucket.{self.bucket}."
        out = {f"{base}endpoint.region": self.region}
        if self.endpoint:
            out |= {f"{base}endpoint": self.endpoint, f"{base}path.style.access": "true"}
        if self.access_key_id and self.secret_access_key:
            out |= {f"{base}access.key": self.access_key_id, f"{base}secret.key": self.secret_access_key}
        return out

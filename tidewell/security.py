"""Who asks: API keys looked up in a table, and credentials taken from headers. Unsigned tokens are not believed."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.catalog import Catalog
from tidewell.errors import AccessDenied
from tidewell.plans.compiler import Options, Plan
from tidewell.spec import Auth, ReadOp

#: Fixed value: the length of a key's indexed prefix.
PREFIX = 12


def credential(headers: Mapping[str, str]) -> str | None:
    """The token of `Authorization: Bearer` or `x-api-key`, in any letter case of the header's name."""
    low = {k.lower(): v.strip() for k, v in headers.items()}
    scheme, _, token = low.get("authorization", "").partition(" ")
    return (token.strip() if scheme.lower() == "bearer" else "") or low.get("x-api-key") or None


def api_key_owner(keys: DataFrame, token: str, id_col: str = "user_id", prefix_col: str = "prefix", hash_col: str = "key_sha256") -> Any:
    """The owner of a live key, or AccessDenied. Revoked, expired and hashless keys have none.

    The prefix narrows the scan and the hash is compared in the query, so any number of
    keys may share a prefix. Of several owners of one key it is the least.
    """
    digest = hashlib.sha256(token.encode()).hexdigest()
    live = keys.filter((F.col(prefix_col) == token[:PREFIX]) & (F.lower(hash_col) == digest))
    if "revoked_at" in keys.columns:
        live = live.filter(F.col("revoked_at").isNull())
    if "expires_at" in keys.columns:
        live = live.filter(F.col("expires_at").isNull() | (F.col("expires_at").cast("timestamp") > F.current_timestamp()))
    found = live.agg(F.min(id_col)).first()[0]
    if found is None:
        raise AccessDenied("no live key matches the token")
    return found


def valid_keys(keys: DataFrame, tokens: DataFrame) -> DataFrame:
    """token and owner of every presented token (column token) that a live key holds: a join, for logs of any size."""
    live = keys.filter(F.col("key_sha256").isNotNull() & F.col("revoked_at").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at").cast("timestamp") > F.current_timestamp())))
    asked = tokens.select("token", F.substring("token", 1, PREFIX).alias("prefix"), F.sha2("token", 256).alias("_hash"))
    return asked.join(live.select("prefix", F.lower("key_sha256").alias("_hash"), "user_id"), ["prefix", "_hash"]).select("token", "user_id").distinct()


def identify(auth: Auth, entity: str, catalog: Catalog, token: str | None) -> Any:
    """The identity that a read with auth runs as."""
    if not token:
        raise AccessDenied("a token is needed")
    keys = catalog.table(entity, auth.table).df
    if (auth.scheme or "").lower() == "api_key_sha256":
        return api_key_owner(keys, token, auth.id_col, hash_col=auth.token_col)
    found = keys.filter(F.col(auth.token_col) == token).agg(F.min(auth.id_col)).first()[0]
    if found is None:
        raise AccessDenied("the token is unknown")
    return found


def secured_read(op: ReadOp, catalog: Catalog, params: Mapping[str, Any] | None = None, headers: Mapping[str, str] | None = None, options: Options = Options()) -> Plan:
    """The plan of op for whoever the headers name. A read that needs an identity and gets none fails."""
    if op.auth is None or not op.auth.enabled:
        return Plan(op, catalog, params, None, options)
    return Plan(op, catalog, params, identify(op.auth, op.entity, catalog, credential(headers or {})), options)

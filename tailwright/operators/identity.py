"""Machines, accounts and request bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import non_empty


def machine_fingerprint(machines: DataFrame) -> DataFrame:
    """fingerprint, hostname, os; a missing hostname counts as empty."""
    both = F.concat("install_id", F.lit("|"), F.coalesce("hostname", F.lit("")))
    return machines.select(F.sha2(both, 256).alias("fingerprint"), "hostname", "os")


def resolve_account(accounts: DataFrame) -> DataFrame:
    """account_id, email, source: an override, else the account file's ids, else the user's name.

    Empty strings are missing. An email goes only with an id of the account file.
    """
    override = non_empty(F.col("override_id"))
    stored = F.coalesce(non_empty(F.col("account_uuid")), non_empty(F.col("user_id")))
    named = F.concat(F.lit("username:"), F.coalesce(non_empty(F.col("username")), F.lit("unknown")))
    from_file = override.isNull() & stored.isNotNull()
    return accounts.select(
        F.coalesce(override, stored, named).alias("account_id"),
        F.when(from_file, non_empty(F.col("email"))).alias("email"),
        F.when(override.isNotNull(), "env").when(from_file, "account-file").otherwise("username").alias("source"),
    )


def build_requests(chunks: DataFrame, batches: DataFrame, machine: Column, account: Column) -> DataFrame:
    """file_path, chunk_no and the JSON body of each chunk's request.

    ``machine``, ``account``: structs; ``batches``: session_id, project_path, git_remote, git_branch and
    sha256 of each file. Missing values are left out of the body; records go in as they are.
    """
    about = F.to_json(
        F.struct(
            F.col("session_id").alias("providerSessionId"),
            F.col("project_path").alias("projectPathAbs"),
            non_empty(F.col("git_remote")).alias("gitRemoteRaw"),
            non_empty(F.col("git_branch")).alias("gitBranch"),
            "sha256",
        )
    )
    body = F.concat(
        F.lit('{"machine":'), F.to_json(machine), F.lit(',"account":'), F.to_json(account), F.lit(',"files":['),
        F.substring(about, F.lit(1), F.length(about) - 1), F.lit(',"records":['), F.array_join("records", ","), F.lit("]}]}"),
    )
    return chunks.join(batches, "file_path").select("file_path", "chunk_no", body.alias("body"))

"""Settings of the raster world as Spark's Hadoop options (never logged).

RULES has a row for each setting: what its text becomes, and the Hadoop option (of the S3A, ABFS and GCS connectors'
documentation) that takes it. A converter gives None where nothing is to be set.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping
from urllib.parse import urlsplit

#: Variables of the environment that may hold options of a store begin with one of these, whatever their case.
PREFIXES = ("AWS_", "GOOGLE", "AZURE_", "OBJECT_STORE_")


def boolean(value: str | None) -> str | None:
    text = (value or "").strip().upper()
    return "true" if text in ("YES", "TRUE", "ON", "1") else "false" if text in ("NO", "FALSE", "OFF", "0") else None


def _opposite(value: str) -> str | None:
    return {"true": "false", "false": "true"}.get(boolean(value))


def _if(wanted: str, then: str) -> Callable[[str], str | None]:
    return lambda value: then if boolean(value) == wanted else None


def _payer(value: str) -> str | None:
    text = value.strip().lower()
    return ("true" if text in ("requester", "true", "yes") else "false") if text else None


RULES: list[tuple[str, Callable[[str], str | None], str]] = [
    ("AWS_HTTPS", _if("false", "false"), "fs.s3a.connection.ssl.enabled"),
    ("AWS_NO_SIGN_REQUEST", _if("true", "org.apache.hadoop.fs.s3a.AnonymousAWSCredentialsProvider"), "fs.s3a.aws.credentials.provider"),
    ("AWS_VIRTUAL_HOSTING", _opposite, "fs.s3a.path.style.access"),
    ("AWS_REQUEST_PAYER", _payer, "fs.s3a.requester.pays.enabled"),
    ("AWS_REGION", str, "fs.s3a.endpoint.region"),
    ("GOOGLE_APPLICATION_CREDENTIALS", str, "fs.gs.auth.service.account.json.keyfile"),
    ("GS_NO_SIGN_REQUEST", _if("true", "UNAUTHENTICATED"), "fs.gs.auth.type"),
]
#: Settings that no connector takes, and what to use instead.
UNSUPPORTED = {
    "AZURE_STORAGE_CONNECTION_STRING": "set the account and its key",
    "GS_ACCESS_KEY_ID": "use a service account's key file",
    "GS_SECRET_ACCESS_KEY": "use a service account's key file",
}


def hadoop_options(settings: Mapping[str, str]) -> dict[str, str]:
    """Options for spark.hadoop.*; settings without a counterpart warn, empty ones are left out."""
    given = {k: v for k, v in settings.items() if v}
    out = {option: value for name, convert, option in RULES if name in given and (value := convert(given[name])) is not None}
    if end := given.get("AWS_S3_ENDPOINT"):
        scheme = "http" if boolean(given.get("AWS_HTTPS")) == "false" else "https"
        out["fs.s3a.endpoint"] = end if end.lower().startswith(("http://", "https://")) else f"{scheme}://{end}"
    if account := given.get("AZURE_STORAGE_ACCOUNT"):
        host = f"{account}.dfs.core.windows.net"
        if boolean(given.get("AZURE_NO_SIGN_REQUEST")) == "true":
            out[f"fs.azure.account.auth.type.{host}"] = "Anonymous"
        elif key := given.get("AZURE_STORAGE_ACCESS_KEY"):
            out[f"fs.azure.account.key.{host}"] = key
        elif token := given.get("AZURE_STORAGE_SAS_TOKEN"):
            out[f"fs.azure.account.auth.type.{host}"] = "SAS"
            out[f"fs.azure.sas.fixed.token.{host}"] = token
        else:
            warnings.warn(f"no key, SAS token or AZURE_NO_SIGN_REQUEST for the account {account}", stacklevel=2)
    for why in {UNSUPPORTED[k] for k in UNSUPPORTED if k in given}:
        names = [k for k in UNSUPPORTED if k in given and UNSUPPORTED[k] == why]
        warnings.warn(f"{', '.join(names)} not supported; {why}", stacklevel=2)
    return out


def settings_for(given: Mapping[str, str], environment: Mapping[str, str], src: str | None = None) -> dict[str, str]:
    """The settings for a source. Later ones win: those given, then the environment's with a known prefix, then the SAS
    token in the source's own address."""
    out = dict(given) | {k: v for k, v in environment.items() if k.upper().startswith(PREFIXES)}
    address = urlsplit(src or "")
    on_azure = address.scheme == "https" and (address.hostname or "").endswith((".blob.core.windows.net", ".dfs.core.windows.net"))
    if on_azure and any(pair.startswith("sig=") for pair in address.query.split("&")):
        out["AZURE_STORAGE_SAS_TOKEN"] = address.query
    return out

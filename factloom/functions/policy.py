"""Access rules: hard denials, layered settings and attribute lists as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.paths import file_name

# What no setting can open.
SECRET_DIRS = (".ssh", ".aws", ".gnupg")
BROWSER_DIRS = (".mozilla", "google-chrome", "chromium", "brave-browser", "bravesoftware")
SECRET_NAMES = ("credential", "secret", ".pem", ".pfx", "id_rsa", "id_ed25519", "id_ecdsa")
# Areas open without a setting, and areas with structured content.
DEFAULT_ON = ("code", "git")
STRUCTURED = ("code", "git", "docker", "systemd")


def hard_denial(path: Column) -> Column:
    """Which fixed rule a path hits, or null. The first path part that hits decides."""
    parts = F.split(F.lower(path), "/")
    rule = lambda p: (
        F.when(p.isin(*SECRET_DIRS), F.concat(F.lit("secret directory "), p))
        .when(p.isin(*BROWSER_DIRS), F.concat(F.lit("browser profile "), p))
    )
    by_dir = F.get(F.filter(F.transform(parts, rule), lambda r: r.isNotNull()), F.lit(0))
    name = F.lower(file_name(path))
    by_name = F.lit(None).cast("string")
    for pattern in reversed(SECRET_NAMES):
        by_name = F.when(F.contains(name, F.lit(pattern)), F.lit(f"secret-like name {pattern}")).otherwise(by_name)
    return F.coalesce(by_dir, by_name)


def layered_settings(names: DataFrame, project: DataFrame, shared: DataFrame, default_on: tuple[str, ...] = ()) -> DataFrame:
    """Resolve (repo, name): project row over shared row over the default, with its source.

    ``project`` is (repo, name, enabled); ``shared`` is (name, enabled).
    """
    p = project.select("repo", "name", F.col("enabled").alias("p_on"))
    s = shared.select("name", F.col("enabled").alias("s_on"))
    default = F.col("name").isin(*default_on) if default_on else F.lit(False)
    return (
        names.join(p, ["repo", "name"], "left")
        .join(s, "name", "left")
        .select(
            "repo",
            "name",
            F.coalesce("p_on", "s_on", default).alias("enabled"),
            F.when(F.col("p_on").isNotNull(), "project-config")
            .when(F.col("s_on").isNotNull(), "shared-config")
            .when(default, "default-enabled")
            .otherwise("default-disabled")
            .alias("source"),
        )
    )


def check_resource(path: Column, domain: Column, enabled: Column, source: Column) -> tuple[Column, Column]:
    """(allowed, reason): a hard denial first, then the resolved switch of the domain."""
    denied = hard_denial(path)
    allowed = denied.isNull() & enabled
    reason = (
        F.when(denied.isNotNull(), F.concat(F.lit("denied always: "), denied))
        .when(enabled, F.concat(domain, F.lit(" is enabled")))
        .otherwise(F.concat(domain, F.lit(" is disabled ("), source, F.lit(")")))
    )
    return allowed, reason


def attribute_allowed(domain: Column, attribute: Column, listed: Column) -> Column:
    """Structured areas allow all; else the list, or file name and metadata without one."""
    low = F.lower(attribute)
    return (
        F.lower(domain).isin(*STRUCTURED)
        | F.coalesce(F.array_contains(F.transform(listed, lambda a: F.lower(a)), low), low.isin("filename", "metadata"))
    )

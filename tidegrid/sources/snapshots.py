"""Inventory snapshots: nested JSON documents read with a schema and flattened into tables.

A snapshot folder holds one document a source.  Documents that are missing give empty tables, so that every
plan runs with whatever sources are there.  Versions are folders with a status; readers
only ever take the version that is active and ready.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.functions import net

STEP = "struct<operation:string,status:string,startTime:string,endTime:string,build_id:string,resource_id:string,action_id:string>"
DEPLOYMENT = f"struct<ip:string,deploy:string,config:string,status:string,error:string,port:string,branch:string,branchSource:string,repository:string,lastPublishedAt:string,publishStatus:string,publishTimeSource:string,pushIn:array<{STEP}>>"
DNS = "struct<id:string,zone:string,name:string,type:string,value:string,line:string,status:string,ttl:int,weight:int,policy:string,remark:string,source:string,row:int,zoneId:string,tenantId:string>"
SERVER = "struct<id:string,ip:string,port:string,weight:int,type:string>"
LISTENER = "struct<protocol:string,port:string,status:string,groupId:string,backendPort:string,forwardPort:string,healthCheck:string,certificates:array<struct<id:string,name:string,domain:string,commonName:string,expiresAt:string>>,rules:array<struct<id:string,domain:string,path:string,groupId:string>>>"
PROCESS = "struct<pid:int,ppid:int,user:string,name:string,kind:string,startedAt:string,elapsedSeconds:bigint,command:string,cpuPercent:double,memPercent:double,rssKB:bigint,vszKB:bigint,system:boolean,ports:array<struct<port:int,address:string,protocol:string>>>"
ROUTE = "struct<domains:array<string>,listen:array<string>,uri:string,directive:string,target:string,upstream:string,file:string,instance:string,context:string,backends:array<struct<host:string,port:string,resolution:string>>>"
APP_PORT = "struct<app:string,kind:string,port:int,addresses:array<string>,pids:array<int>,candidatePids:array<int>,ownershipConfidence:string,basis:string>"
#: source -> (file, schema of the document)
DOCUMENTS = {
    "apps": ("snapshot.json", f"collectedAt string, complete boolean, apps array<struct<id:string,name:string,appType:string,http:string,port:string,repository:string,branch:string,capturedAt:string,envs:map<string,array<{DEPLOYMENT}>>>>"),
    "repositories": ("repositories.json", "snapshotDate string, complete boolean, repos array<struct<id:string,name:string,url:string,path:string,groupId:string,groupName:string,access:string,reason:string,match:string,difference:string,inCodeup:boolean,inDevops:boolean,commits:int,lastCommittedAt:string,commitDailyCounts:map<string,int>,apps:array<struct<id:string,name:string,branch:string>>>>, groups array<struct<id:string,name:string,path:string,parentId:string>>"),
    "dns": ("dns-snapshot.json", f"collectedAt string, zones array<string>, records array<{DNS}>"),
    "cloud_dns": ("cloud-dns-snapshot.json", f"available boolean, collectedAt string, zones array<struct<id:string,name:string,visibility:string,recordCount:int,recordsCollected:boolean,records:array<{DNS}>>>"),
    "eip": ("eip-snapshot.json", "snapshotDate string, records array<struct<key:string,id:string,name:string,owner:string,ip:string,bindingType:string,bindingId:string,bindingName:string,status:string,bandwidth:string,network:string,row:int,notes:array<struct<column:int,value:string>>>>"),
    "nat": ("nat-snapshot.json", "available boolean, collectedAt string, gateways array<struct<id:string,name:string,status:string,vpcId:string,tenantId:string,entries:array<struct<id:string,tableId:string,name:string,externalIp:string,externalPort:string,internalIp:string,internalPort:string,protocol:string,status:string>>>>"),
    "compute": ("ecs-snapshot.json", "fetchedAt string, instances array<struct<id:string,name:string,projectId:string,cpu:int,memoryGiB:double,os:string,privateIps:array<string>,publicIps:array<string>,tags:map<string,string>,status:string,region:string,zone:string,instanceType:string,tenantId:string,accountId:string,observedAt:string>>"),
    "balancers": ("clb-snapshot.json", f"available boolean, collectedAt string, partial boolean, instances array<struct<id:string,name:string,ip:string,addressType:string,status:string,listeners:array<{LISTENER}>,groups:array<struct<id:string,name:string,kind:string,servers:array<{SERVER}>>>>>"),
    "assets": ("jumpserver-snapshot.json", f"collectedAt string, assets array<struct<id:string,hostname:string,ip:string,os:string,platform:string,inspection:struct<checkedAt:string,loginStatus:string,processStatus:string,nginxStatus:string,configurationVersion:string,processes:array<{PROCESS}>,appPorts:array<{APP_PORT}>,nginxRoutes:array<{ROUTE}>,webapps:struct<status:string,apps:array<struct<name:string,mtime:string>>>>>>, groups array<struct<id:string,name:string,key:string,parentKey:string,path:string,org_id:string,assetIds:array<string>>>"),
    "databases": ("dms-snapshot.json", "available boolean, collectedAt string, instances array<struct<name:string,id:string,address:string,dbType:string,region:string,ip:string,loginStatus:string,env:string,source:string,status:string,version:string,dmsIds:array<string>,duplicated:int>>"),
    "specs": ("server-specs.json", "collectedAt string, available boolean, specs array<struct<ip:string,hostname:string,assetId:string,loginStatus:string,cpu:int,memoryMB:int,os:string>>"),
}


def read_document(spark: SparkSession, folder: str, source: str) -> DataFrame:
    """The document of a source, one row; no row if the file isn't there."""
    name, schema = DOCUMENTS[source]
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(f"{folder}/{name}", multiLine=True)


def documents(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {source: read_document(spark, folder, source) for source in DOCUMENTS}


def active_version(versions: DataFrame, pointer: DataFrame) -> DataFrame:
    """The row of versions (id, status, ...) that pointer (id) names, if it is ready; never one that is being collected."""
    return versions.join(pointer.select("id"), "id").where("status = 'ready'")


def flatten(doc: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Flat tables of the documents, one a grain; addresses and ports normalized."""
    up = lambda df, column, keep="": df.select(*keep.split(), F.explode(column).alias("x"))
    ip, port = net.normalize_ip, net.normalize_port
    t: dict[str, DataFrame] = {}
    apps = up(doc["apps"], "apps", "collectedAt").select(F.col("collectedAt").alias("at"), "x.*")
    t["apps"] = apps.select("id", "name", "http", net.normalize_port(F.col("port")).alias("port"), net.canonical_git_url(F.col("repository")).alias("repository"), "at")
    rows = apps.select(F.col("id").alias("app_id"), F.col("name").alias("app_name"), F.col("port").alias("app_port"), "at", F.explode("envs").alias("env", "rows"))
    t["environments"] = rows.select("app_id", "env", F.col("rows").alias("rows"))
    t["deployments"] = rows.select("app_id", "app_name", "env", "at", "app_port", F.explode("rows").alias("d")).select(
        "app_id", "app_name", "env", "at", F.col("d.deploy").alias("deploy"), ip(F.col("d.ip")).alias("ip"), port(F.coalesce(F.nullif(F.col("d.port"), F.lit("")), F.col("app_port"))).alias("port"),
        net.canonical_git_url(F.col("d.repository")).alias("repository"), F.col("d.config").alias("config"), F.col("d.status").alias("status"), F.col("d.lastPublishedAt").alias("lastPublishedAt"),
        F.col("d.publishStatus").alias("publishStatus"), F.col("d.pushIn").alias("pushIn"),
    )
    t["repositories"] = up(doc["repositories"], "repos").select("x.*").withColumn("canonical", net.canonical_git_url(F.col("url")))
    t["repository_groups"] = up(doc["repositories"], "groups").select("x.*")
    cloud = up(doc["cloud_dns"].where("available"), "zones").select("x.*")
    t["dns"] = dns_records(up(doc["dns"], "records").select("x.*"), cloud)
    t["public_zones"] = cloud.where("visibility = 'public'").select(net.normalize_domain(F.col("name")).alias("zone")).distinct()
    t["eip"] = up(doc["eip"], "records").select("x.*").withColumn("ip", ip(F.col("ip")))
    t["nat"] = up(doc["nat"].where("available"), "gateways").select(F.col("x.id").alias("gateway"), F.col("x.name").alias("gateway_name"), F.col("x.status").alias("gateway_status"), F.explode_outer("x.entries").alias("e")).select(
        "gateway", "gateway_name", "gateway_status", F.col("e.id").alias("entry"), ip(F.col("e.externalIp")).alias("external_ip"), port(F.col("e.externalPort")).alias("external_port"),
        ip(F.col("e.internalIp")).alias("internal_ip"), port(F.col("e.internalPort")).alias("internal_port"), net.normalize_protocol(F.col("e.protocol")).alias("protocol"), F.col("e.status").alias("status"),
    )
    t["compute"] = up(doc["compute"], "instances").select("x.*")
    lb = up(doc["balancers"].where("available"), "instances").select("x.*").withColumn("ip", ip(F.col("ip")))
    t["balancers"] = lb.select("id", "name", "ip", "addressType", "status")
    group = F.coalesce(F.nullif(F.trim("l.groupId"), F.lit("")), F.lit("default"))
    t["listeners"] = lb.select(F.col("id").alias("lb"), F.col("name").alias("lb_name"), F.explode("listeners").alias("l")).select(
        "lb", "lb_name", net.normalize_protocol(F.col("l.protocol")).alias("protocol"), port(F.col("l.port")).alias("port"), group.alias("group_id"), F.col("l.status").alias("status"),
        F.col("l.backendPort").alias("backendPort"), F.col("l.forwardPort").alias("forwardPort"), F.col("l.rules").alias("rules"), F.col("l.certificates").alias("certificates"),
    )
    t["groups"] = lb.select(F.col("id").alias("lb"), F.explode("groups").alias("g")).select("lb", F.coalesce(F.nullif(F.trim("g.id"), F.lit("")), F.lit("default")).alias("group_id"), F.col("g.name").alias("name"), F.col("g.kind").alias("kind"), F.col("g.servers").alias("servers"))
    t["servers"] = t["groups"].select("lb", "group_id", F.explode("servers").alias("s")).select("lb", "group_id", F.col("s.id").alias("server_id"), ip(F.col("s.ip")).alias("ip"), port(F.col("s.port")).alias("port"), F.col("s.weight").alias("weight")).where("ip <> ''")
    assets = up(doc["assets"], "assets").select("x.*").withColumn("ip", ip(F.col("ip")))
    t["assets"] = assets.select("id", "hostname", "ip", "os", "platform", F.col("inspection.checkedAt").alias("checkedAt"), F.col("inspection.loginStatus").alias("loginStatus"))
    t["asset_groups"] = up(doc["assets"], "groups").select("x.*")
    part = lambda name: assets.select(F.col("id").alias("asset"), "hostname", F.col("ip").alias("asset_ip"), F.col("inspection.checkedAt").alias("checkedAt"), F.explode(f"inspection.{name}").alias("x")).select("asset", "hostname", "asset_ip", "checkedAt", "x.*")
    t["processes"], t["routes"], t["app_ports"] = part("processes"), part("nginxRoutes"), part("appPorts")
    t["databases"] = up(doc["databases"].where("available"), "instances").select("x.*")
    t["specs"] = up(doc["specs"].where("available"), "specs").select("x.*")
    return t


def dns_records(static: DataFrame, cloud_zones: DataFrame) -> DataFrame:
    """Records of both kinds of source: a public cloud zone takes the place of the static records of that zone; private ones stay out."""
    public = cloud_zones.where("visibility = 'public'")
    zone = net.normalize_domain(F.col("zone"))
    kept = static.join(public.select(net.normalize_domain(F.col("name")).alias("_z")).distinct(), zone == F.col("_z"), "left_anti")
    made = kept.unionByName(public.select(F.explode("records").alias("r")).select("r.*"), allowMissingColumns=True)
    return made.withColumn("name", net.normalize_domain(F.col("name"))).withColumn("type", F.upper(F.trim("type")))


# checks before a version is published -----------------------------------------------------------
def require(df: DataFrame, message: str) -> None:
    """Raise if df, the rows that break a rule, has any."""
    if not df.isEmpty():
        raise ValueError(f"{message}: {df.limit(5).collect()}")


def check_snapshot(doc: dict[str, DataFrame], needed: Sequence[str] = ("apps", "dns", "compute", "assets")) -> None:
    """The publication gate: documents that must be there, unique ids, groups that name known assets."""
    for source in needed:
        if doc[source].isEmpty():
            raise ValueError(f"missing source: {source}")
    t = flatten(doc)
    for name, key in (("apps", "id"), ("compute", "id"), ("assets", "id"), ("balancers", "id")):
        require(t[name].groupBy(key).count().where("count > 1"), f"duplicate {name}")
    members = t["asset_groups"].select(F.explode("assetIds").alias("id")).distinct()
    require(members.join(t["assets"], "id", "left_anti"), "groups with unknown assets")


def check_pages(pages: DataFrame, total_col: str = "total", id_col: str = "id") -> None:
    """A listing read page by page: one total on all pages, unique ids, as many as the total."""
    row = pages.agg(F.min(total_col).alias("a"), F.max(total_col).alias("b"), F.count("*").alias("n"), F.countDistinct(id_col).alias("ids")).first()
    if row["n"] and (row["a"] != row["b"] or row["ids"] != row["n"] or row["n"] != row["a"]):
        raise ValueError(f"listing changed or ended early: {row}")


def read_table(spark: SparkSession, path: str, required: Sequence[str], notes: bool = False) -> DataFrame:
    """A CSV file with a header: required columns must be there, blank rows go; notes: unnamed columns' values as (column, value)."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    missing = [c for c in required if c not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    filled = raw.where(F.coalesce(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in raw.columns]).isNotNull())
    if not notes:
        return filled
    loose = [c for c in raw.columns if c.startswith("_c") and c[2:].isdigit()]
    cells = F.array(*[F.struct(F.lit(int(c[2:])).alias("column"), F.col(c).alias("value")) for c in loose]) if loose else F.array().cast(T.ArrayType(T.StructType().add("column", "int").add("value", "string")))
    return filled.withColumn("notes", F.filter(cells, lambda n: F.coalesce(F.trim(n["value"]), F.lit("")) != "")).drop(*loose)


def resume(entities: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Entities that an earlier, broken run did not finish."""
    return entities.join(done.select(key).distinct(), key, "left_anti")

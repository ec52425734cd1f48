"""A small invented site: names, addresses and documents of every source."""

from __future__ import annotations

import json


def deployment(ip, deploy, port="", status="success", **more):
    return {"ip": ip, "deploy": deploy, "config": "c", "status": status, "error": "", "port": port, **more}


def app(id_, name, envs, port="", repository=""):
    return {"id": id_, "name": name, "http": "yes", "port": port, "repository": repository, "branch": "main", "capturedAt": "2024-03-01T00:00:00Z", "envs": envs}


def dns(id_, name, kind, value, status="active", zone="example.com"):
    return {"id": id_, "zone": zone, "name": name, "type": kind, "value": value, "line": "default", "status": status, "source": "static", "row": 1}


def route(domains, target, backends, uri="/", directive="proxy_pass", listen=("80",), context="http"):
    return {"domains": list(domains), "listen": list(listen), "uri": uri, "directive": directive, "target": target, "upstream": target, "file": "site.conf", "instance": "main", "context": context, "backends": [{"host": h, "port": p, "resolution": r} for h, p, r in backends]}


SITE = {
    "snapshot.json": {"collectedAt": "2024-03-01T00:00:00Z", "complete": True, "apps": [
        app("100", "shop", {"PRODUCT": [deployment("10.0.0.10", "d1", "8080"), deployment("10.0.0.11", "d2", "8080")], "TEST": [deployment("10.0.1.10", "d3")]}, repository="git@code.example.com:team/shop.git"),
        app("101", "pay", {"PRODUCT": [deployment("10.0.0.12", "d4", "9090"), deployment("10.0.0.10", "d5")]}),
        app("102", "pay-twin", {"PRODUCT": [deployment("10.0.0.12", "d6", "9090")]}),
        app("103", "lonely", {"PRODUCT": [deployment("", "d7", "1")]}, repository="https://code.example.com/team/lonely"),
    ]},
    "repositories.json": {"snapshotDate": "2024-03-01", "complete": True, "repos": [{"id": "r1", "name": "shop", "url": "https://code.example.com/team/shop.git", "path": "team/shop", "difference": "both"}], "groups": []},
    "dns-snapshot.json": {"collectedAt": "2024-03-01T00:00:00Z", "zones": ["example.com"], "records": [
        dns("n1", "www.example.com", "CNAME", "edge.example.com."), dns("n2", "edge.example.com", "A", "203.0.113.1"), dns("n3", "lb.example.com", "A", "203.0.113.2"), dns("n4", "nat.example.com", "A", "203.0.113.3"),
        dns("n5", "out.example.com", "CNAME", "cdn.other.net"), dns("n6", "gone.example.com", "CNAME", "missing.example.com"), dns("n7", "a.example.com", "CNAME", "b.example.com"), dns("n8", "b.example.com", "CNAME", "a.example.com"),
        dns("n9", "off.example.com", "A", "198.51.100.9", status="paused"), dns("n10", "two.example.com", "A", "203.0.113.4"), dns("n11", "x.cloud.test", "A", "198.51.100.1", zone="cloud.test"),
    ]},
    "cloud-dns-snapshot.json": {"available": True, "collectedAt": "2024-03-01T00:00:00Z", "zones": [
        {"id": "z1", "name": "cloud.test", "visibility": "public", "recordCount": 1, "recordsCollected": True, "records": [dns("c1", "y.cloud.test", "A", "203.0.113.2", zone="cloud.test")]},
        {"id": "z2", "name": "inner.test", "visibility": "private", "recordCount": 1, "recordsCollected": True, "records": [dns("c2", "p.inner.test", "A", "10.9.9.9", zone="inner.test")]},
    ]},
    "eip-snapshot.json": {"snapshotDate": "2024-03-01", "records": [
        {"id": "e1", "name": "edge", "ip": "203.0.113.1", "bindingType": "instance", "bindingId": "i-proxy", "row": 1}, {"id": "e2", "name": "lb", "ip": "203.0.113.2", "bindingType": "lb", "bindingId": "lb-1", "row": 2},
        {"id": "e3", "name": "nat", "ip": "203.0.113.3", "bindingType": "nat", "bindingId": "ngw-1", "row": 3}, {"id": "e4", "name": "loose", "ip": "203.0.113.4", "bindingType": "eni", "bindingId": "unknown", "row": 4},
    ]},
    "nat-snapshot.json": {"available": True, "collectedAt": "2024-03-01T00:00:00Z", "gateways": [{"id": "ngw-1", "name": "gw", "status": "Available", "vpcId": "v", "entries": [
        {"id": "s1", "externalIp": "203.0.113.3", "externalPort": "80", "internalIp": "10.0.0.10", "internalPort": "8080", "protocol": "tcp", "status": "Available"},
        {"id": "s2", "externalIp": "203.0.113.3", "externalPort": "8000-8010", "internalIp": "10.0.0.12", "internalPort": "9090", "protocol": "tcp", "status": "Available"},
    ]}]},
    "ecs-snapshot.json": {"fetchedAt": "2024-03-01T00:00:00Z", "instances": [
        {"id": "i-proxy", "name": "proxy", "privateIps": ["10.0.0.5"], "publicIps": [], "cpu": 4, "memoryGiB": 8.0, "tags": {"team": "edge", "empty": ""}, "status": "running"},
        {"id": "i-shop", "name": "shop", "privateIps": ["10.0.0.10"], "publicIps": ["203.0.113.4"], "cpu": 8, "memoryGiB": 16.0, "tags": {}, "status": "running"},
    ]},
    "clb-snapshot.json": {"available": True, "collectedAt": "2024-03-01T00:00:00Z", "instances": [{"id": "lb-1", "name": "front", "ip": "203.0.113.2", "addressType": "internet", "status": "active", "listeners": [
        {"protocol": "http", "port": "80", "status": "running", "groupId": "g1", "rules": [{"id": "u1", "domain": "lb.example.com", "path": "/pay", "groupId": "g2"}, {"id": "u2", "domain": "*.example.com", "path": "/pay", "groupId": "g1"}], "certificates": []},
    ], "groups": [
        {"id": "g1", "name": "shops", "kind": "default", "servers": [{"id": "i-shop", "ip": "10.0.0.10", "port": "8080", "weight": 1}, {"id": "i-2", "ip": "10.0.0.11", "port": "8080", "weight": 1}]},
        {"id": "g2", "name": "pays", "kind": "rule", "servers": [{"id": "i-3", "ip": "10.0.0.12", "port": "9090", "weight": 1}]},
    ]}]},
    "jumpserver-snapshot.json": {"collectedAt": "2024-03-01T00:00:00Z", "groups": [{"id": "p", "name": "g", "key": "1", "assetIds": ["as1"]}], "assets": [
        {"id": "as1", "hostname": "proxy", "ip": "10.0.0.5", "inspection": {"checkedAt": "2024-03-01T00:00:00Z", "loginStatus": "ok", "nginxStatus": "ok", "processes": [], "appPorts": [], "nginxRoutes": [
            route(["www.example.com", "edge.example.com"], "http://shop_pool", [("10.0.0.10", "8080", "ip"), ("10.0.0.11", "8080", "ip")]),
            route(["www.example.com"], "http://pay_pool", [("10.0.0.12", "9090", "ip")], uri="/pay/"),
            route(["www.example.com"], "http://var", [("$host", None, "dynamic")], uri="/dyn/"),
            route(["www.example.com"], "", [], uri="/deny", directive="access_control"),
        ]}},
        {"id": "as2", "hostname": "shop", "ip": "10.0.0.10", "inspection": {"checkedAt": "2024-03-01T00:00:00Z", "loginStatus": "ok", "processes": [], "nginxRoutes": [], "appPorts": [{"app": "shop", "kind": "jar", "port": 8080, "addresses": ["*"], "pids": [1]}, {"app": "admin", "kind": "jar", "port": 9999, "addresses": ["*"], "pids": [2]}]}},
        {"id": "as3", "hostname": "nowhere", "ip": "", "inspection": {"checkedAt": "2024-03-01T00:00:00Z", "appPorts": [{"app": "q", "kind": "jar", "port": 1, "addresses": [], "pids": []}]}},
    ]},
}


def write_site(folder, site=SITE):
    for name, doc in site.items():
        (folder / name).write_text(json.dumps(doc))
    return f"file://{folder}"

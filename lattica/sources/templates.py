"""Built-in example graphs."""

from __future__ import annotations

from pyspark.sql import SparkSession

from lattica.operators.tasks import compute_ready
from lattica.plans.graph import GraphError, PropertyGraph

# Title, description, direction, nodes (id, label, x, y), edges (from, to, weight), statuses, metadata.
TEMPLATES: dict[str, dict] = {
    "workflow": {
        "title": "CI/CD Workflow",
        "description": "Fan-out/fan-in DAG — try topo sort, roots, and leaves",
        "directed": True,
        "nodes": [
            ("push", "Push", 450, 50), ("lint", "Lint", 200, 180), ("test", "Test", 450, 180), ("build", "Build", 700, 180),
            ("scan", "Security Scan", 200, 330), ("coverage", "Coverage", 450, 330), ("docker", "Docker", 700, 330),
            ("staging", "Staging", 450, 480), ("deploy", "Deploy", 450, 620),
        ],
        "edges": [
            ("push", "lint", 1), ("push", "test", 1), ("push", "build", 1), ("lint", "scan", 1), ("test", "coverage", 1),
            ("build", "docker", 1), ("scan", "staging", 1), ("coverage", "staging", 1), ("docker", "staging", 1), ("staging", "deploy", 1),
        ],
        "meta": {
            "push": {"trigger": "on_push", "branch": "main"},
            "lint": {"tool": "golangci-lint", "config": ".golangci.yml"},
            "test": {"framework": "go test", "flags": "-race -v", "min_coverage": "80%"},
            "build": {"output": "./bin/app", "os": "linux", "arch": "amd64"},
            "scan": {"tool": "gosec", "severity": "high"},
            "docker": {"base_image": "golang:1.22-alpine", "registry": "ghcr.io", "tag": "latest"},
            "deploy": {"environment": "production", "region": "us-east-1", "replicas": 3},
        },
    },
    "knowledge": {
        "title": "Knowledge Graph",
        "description": "Undirected concept map — try BFS, DFS, and components",
        "directed": False,
        "nodes": [
            ("ml", "Machine Learning", 450, 60), ("nn", "Neural Nets", 250, 180), ("dl", "Deep Learning", 100, 330), ("cnn", "CNN", 250, 450),
            ("nlp", "NLP", 450, 200), ("transformers", "Transformers", 450, 370), ("stats", "Statistics", 700, 100),
            ("regression", "Regression", 800, 250), ("pca", "PCA", 700, 400), ("rl", "Reinforcement", 600, 550),
        ],
        "edges": [
            ("ml", "nn", 1), ("ml", "nlp", 1), ("ml", "stats", 1), ("nn", "dl", 1), ("dl", "cnn", 1), ("nlp", "transformers", 1),
            ("nn", "transformers", 1), ("stats", "regression", 1), ("stats", "pca", 1), ("ml", "rl", 1), ("transformers", "rl", 1),
        ],
        "meta": {
            "ml": {"field": "Computer Science", "since": 1959},
            "nn": {"inspired_by": "biological neurons", "key_paper": "Perceptrons (1969)"},
            "cnn": {"use_case": "image recognition", "key_paper": "ImageNet (2012)"},
            "nlp": {"applications": ["translation", "summarization", "chat"]},
            "transformers": {"key_paper": "Attention Is All You Need", "year": 2017, "authors": "Vaswani et al."},
            "rl": {"applications": ["game AI", "robotics", "resource management"]},
        },
    },
    "dependencies": {
        "title": "Dependency Tree",
        "description": "Package dependency DAG — try ancestors, descendants, topo sort",
        "directed": True,
        "nodes": [
            ("app", "app", 450, 50), ("api", "api", 250, 170), ("web", "web", 650, 170), ("auth", "auth", 100, 310), ("db", "db", 350, 310), ("ui", "ui", 550, 310),
            ("router", "router", 750, 310), ("crypto", "crypto", 100, 460), ("logger", "logger", 300, 460), ("config", "config", 500, 460), ("utils", "utils", 700, 460),
        ],
        "edges": [
            ("app", "api", 1), ("app", "web", 1), ("api", "auth", 1), ("api", "db", 1), ("web", "ui", 1), ("web", "router", 1), ("auth", "crypto", 1),
            ("auth", "logger", 1), ("db", "logger", 1), ("db", "config", 1), ("ui", "config", 1), ("router", "utils", 1), ("router", "logger", 1),
        ],
    },
    "statemachine": {
        "title": "State Machine",
        "description": "Has cycles from retry/return flows — try cycle detection",
        "directed": True,
        "nodes": [
            ("idle", "Idle", 120, 300), ("validating", "Validating", 300, 150), ("processing", "Processing", 520, 150), ("waiting", "Waiting", 700, 300),
            ("retrying", "Retrying", 520, 450), ("completed", "Completed", 700, 530), ("failed", "Failed", 300, 530), ("cancelled", "Cancelled", 120, 500),
        ],
        "edges": [
            ("idle", "validating", 1), ("validating", "processing", 1), ("validating", "failed", 1), ("processing", "waiting", 1), ("processing", "failed", 1), ("waiting", "completed", 1),
            ("waiting", "retrying", 1), ("retrying", "processing", 1), ("retrying", "failed", 1), ("idle", "cancelled", 1), ("failed", "idle", 1),
        ],
    },
    "orgchart": {
        "title": "Org Chart",
        "description": "Strict tree hierarchy — try roots, leaves, BFS",
        "directed": True,
        "nodes": [
            ("ceo", "CEO", 450, 50), ("cto", "CTO", 220, 180), ("cfo", "CFO", 450, 180), ("cmo", "CMO", 680, 180), ("eng1", "Eng Lead", 120, 340), ("eng2", "Architect", 320, 340),
            ("fin1", "Controller", 450, 340), ("mkt1", "Brand Lead", 580, 340), ("mkt2", "Growth Lead", 780, 340), ("dev1", "Dev A", 70, 500), ("dev2", "Dev B", 220, 500),
        ],
        "edges": [
            ("ceo", "cto", 1), ("ceo", "cfo", 1), ("ceo", "cmo", 1), ("cto", "eng1", 1), ("cto", "eng2", 1), ("cfo", "fin1", 1),
            ("cmo", "mkt1", 1), ("cmo", "mkt2", 1), ("eng1", "dev1", 1), ("eng1", "dev2", 1),
        ],
    },
    "microservices": {
        "title": "Microservices",
        "description": "Weighted edges (latency in ms) — try shortest path",
        "directed": True,
        "nodes": [
            ("gateway", "Gateway", 450, 50), ("auth", "Auth", 200, 180), ("users", "Users", 450, 180), ("orders", "Orders", 700, 180), ("products", "Products", 200, 350),
            ("payments", "Payments", 450, 350), ("inventory", "Inventory", 700, 350), ("notify", "Notify", 300, 520), ("cache", "Cache", 550, 520), ("db", "Database", 700, 520),
        ],
        "edges": [
            ("gateway", "auth", 5), ("gateway", "users", 12), ("gateway", "orders", 15), ("auth", "users", 8), ("auth", "cache", 2), ("users", "notify", 20), ("orders", "payments", 25),
            ("orders", "inventory", 10), ("products", "inventory", 7), ("products", "cache", 3), ("payments", "notify", 15), ("inventory", "db", 5), ("cache", "db", 4),
        ],
        "meta": {
            "gateway": {"port": 8080, "rate_limit": "1000/min", "timeout_ms": 30000},
            "auth": {"strategy": "JWT", "token_ttl": "1h", "issuer": "auth-service"},
            "notify": {"channels": ["email", "slack", "webhook"], "retry_count": 3},
            "cache": {"engine": "Redis", "ttl_seconds": 300, "max_memory": "256mb"},
            "db": {"engine": "PostgreSQL", "version": "15", "pool_size": 20},
        },
    },
    "taskplan": {
        "title": "Task Plan",
        "description": "Task execution plan with statuses and metadata — click nodes to inspect",
        "directed": True,
        "nodes": [
            ("analyze", "Analyze", 450, 50), ("plan", "Plan", 450, 180), ("research", "Research", 250, 320), ("setup", "Setup", 650, 320),
            ("implement", "Implement", 450, 460), ("test", "Test", 450, 590), ("review", "Review", 450, 720), ("deploy", "Deploy", 450, 850),
        ],
        "edges": [
            ("analyze", "plan", 1), ("plan", "research", 1), ("plan", "setup", 1), ("research", "implement", 1),
            ("setup", "implement", 1), ("implement", "test", 1), ("test", "review", 1), ("review", "deploy", 1),
        ],
        "status": {"analyze": "done", "plan": "done", "research": "running", "setup": "done", "implement": "ready", "test": "pending", "review": "pending", "deploy": "pending"},
        "meta": {
            "analyze": {"prompt": "Analyze the codebase structure and identify key components", "temperature": 0.3, "output_format": "structured_json"},
            "plan": {"strategy": "top-down decomposition", "max_tasks": 8, "priority": "correctness"},
            "research": {"sources": ["documentation", "source code", "tests"], "depth": "comprehensive", "query": "graph metadata systems"},
            "setup": {"runtime": "go1.22", "environment": "development"},
            "implement": {"language": "Go", "pattern": "method receiver", "files": ["store.go", "graph.go"]},
            "test": {"framework": "testing", "coverage_target": "90%", "race_detector": True},
            "review": {"checklist": ["correctness", "edge cases", "documentation"]},
            "deploy": {"target": "production", "strategy": "blue-green", "rollback_plan": True},
        },
    },
}


def codebase() -> dict:
    """A source tree: files beside each other in rows of six, directories below, the edges by
    what contains and what tests what."""
    sources = [f"{name}.go" for name in ("graph", "traverse", "query", "task", "store", "serialize")]
    tests = [s.replace(".", "_test.") for s in sources]
    rows = [sources, tests, ["meta_test.go", "go.mod", "Makefile", "README.md", "doc.go", ".gitignore"]]
    heights = (170, 320, 440)
    nodes = [("repo", "repo/", 450, 30)] + [(f, f, 80 + 150 * i, y) for row, y in zip(rows, heights) for i, f in enumerate(row)]
    nodes += [("cmd", "cmd/", 450, 560), ("visualizer", "visualizer/", 450, 660), ("main.go", "main.go", 280, 770), ("templates.go", "templates.go", 450, 770), ("static", "static/", 620, 770), ("index.html", "index.html", 620, 880)]
    inside = [("repo", f) for row in rows for f in row] + [("repo", "cmd"), ("cmd", "visualizer"), ("visualizer", "main.go"), ("visualizer", "templates.go"), ("visualizer", "static"), ("static", "index.html")]
    meta = {id_: {"type": "directory" if label.endswith("/") else "file"} for id_, label, _, _ in nodes}
    for s, t in zip(sources, tests):
        meta[t]["test_file_for"] = s
    edges = [(a, b, 1, "contains") for a, b in inside] + [(s, t, 1, "tested by") for s, t in zip(sources, tests)]
    return {"title": "Codebase File Tree", "description": "Source file tree with file metadata — try roots, leaves, descendants, ancestors", "directed": True, "nodes": nodes, "edges": edges, "meta": meta}


TEMPLATES["codebase"] = codebase()


def known(name: str) -> dict:
    if name not in TEMPLATES:
        raise GraphError(f"unknown template {name}")
    return TEMPLATES[name]


def template(spark: SparkSession, name: str) -> PropertyGraph:
    """A template's graph, as it is loaded: nodes whose dependencies are done are ready."""
    t = known(name)
    nodes = [{"id": i, "label": label, "status": t.get("status", {}).get(i, ""), "meta": t.get("meta", {}).get(i, {})} for i, label, _, _ in t["nodes"]]
    edges = [{"src": a, "dst": b, "weight": float(w), "label": label[0] if label else ""} for a, b, w, *label in t["edges"]]
    return compute_ready(PropertyGraph.build(spark, nodes, edges, t["directed"]))


def positions(name: str) -> dict[str, dict]:
    """Where a template's nodes are drawn."""
    return {i: {"x": float(x), "y": float(y)} for i, _, x, y in known(name)["nodes"]}


def template_list() -> list[dict]:
    return [{"id": k, "name": t["title"], "description": t["description"], "directed": t["directed"], "node_count": len(t["nodes"]), "edge_count": len(t["edges"])} for k, t in TEMPLATES.items()]

"""Wire formats of registries and repository searches."""

from __future__ import annotations

#: The public server description format.
SERVER_JSON = """name string, title string, description string, version string, repository struct<url:string>, websiteUrl string,
remotes array<struct<type:string,url:string>>, packages array<struct<registryType:string,identifier:string,version:string,transport:struct<type:string>>>"""
SERVER = "struct<" + SERVER_JSON.replace("\n", " ").replace(" string", ":string").replace("repository struct", "repository:struct").replace("remotes array", "remotes:array").replace("packages array", "packages:array") + ">"
#: The public key of registry metadata.
OFFICIAL = "io.modelcontextprotocol.registry/official"
REGISTRY_PAGE = f"servers array<struct<server:{SERVER},_meta:struct<`{OFFICIAL}`:struct<status:string,isLatest:boolean,updatedAt:string>>>>, metadata struct<nextCursor:string,count:bigint>"
#: Pages of a repository search, with the place of the topic query that found them.
SEARCH_PAGE = """query_idx int, total_count bigint, items array<struct<full_name:string,name:string,owner:struct<login:string>,description:string,html_url:string,
homepage:string,topics:array<string>,pushed_at:string,stargazers_count:bigint,default_branch:string,archived:boolean>>"""
TOPIC_QUERIES = ("topic:mcp-server", "topic:model-context-protocol", "topic:mcp")

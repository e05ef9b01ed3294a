"""Explicit schemas of the datasets. Nothing is inferred."""

ITEM_ROW = """
id string, name string, publicCode string, collectorNumber int, `set` string, setId string,
domains array<string>, rarity string, cardTypes array<string>, superTypes array<string>,
energy string, might string, power string, tags array<string>, orientation string,
imageUrl string, imageAlt string, abilityText string
"""
LINK_ROW = """
id string, title string, name string, kind string, type string, pageId string, url string,
summary string, source string, updatedAt string
"""
RAW_LABEL = "struct<value:struct<label:string,id:string>>"
RAW_BODY = "struct<richText:struct<body:string>>"
RAW_ITEM = f"""struct<id:string, name:string, publicCode:string, collectorNumber:int,
set:{RAW_LABEL}, domain:struct<values:array<struct<label:string>>>, rarity:{RAW_LABEL},
cardType:struct<type:array<struct<label:string>>,superType:array<struct<label:string>>>,
energy:{RAW_LABEL}, might:{RAW_LABEL}, power:{RAW_LABEL}, tags:struct<tags:array<string>>,
text:{RAW_BODY}, effect:{RAW_BODY}, cardImage:struct<url:string,accessibilityText:string>,
orientation:string>"""
BLADE = f"""struct<type:string, fragmentId:string, header:struct<title:string,subtitle:string>,
groups:array<struct<label:string,content:struct<body:string>>>, richText:struct<body:string>,
cards:struct<items:array<{RAW_ITEM}>>>"""
PAYLOAD = f"""struct<props:struct<pageProps:struct<page:struct<title:string,
description:string, displayedPublishDate:string, blades:array<{BLADE}>>>>>"""

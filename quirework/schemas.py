"""Schemas of the tables that jobs read and write."""

FORMS = "array<struct<fields:array<string>,field_count:int,likely_lead_capture:boolean>>"
PARSED = f"main_text string, meta map<string,string>, links array<string>, forms {FORMS}, actions array<struct<text:string,classes:string>>"

"""Schemas of the relations, as DDL; nested relations are arrays of structs."""

FINDING = "finding_id string, experiment_id string, tool string, harness_version string, model string, prompt_version string, vulnerability_type string, cwe string, severity string, confidence double, file string, start_line int, end_line int, function string, source string, sink string, data_flow array<string>, description string, evidence string, attack_scenario string, security_control string, recommendation string, validation_status string, validator string, validator_confidence double, duplicate_of string, notes string"
FINDING_COLUMNS = [x.strip().split(" ")[0] for x in FINDING.split(", ")]
#: Fields of a finding as a model or a tool gives them: strings, to be brought into form.
RAW_FINDING = ", ".join(f"{c} array<string>" if c == "data_flow" else f"{c} string" for c in FINDING_COLUMNS) + ", is_vulnerable boolean"
CANDIDATE = "candidate_id string, category string, file string, line int, symbol string, matched_rule string, snippet string, context_refs array<string>, priority string, is_rejected boolean, rejection_reason string"
GROUND_TRUTH = "ground_truth_id string, lesson string, module string, vulnerability_type string, cwe string, relevant_files array<string>, expected_vulnerable_behavior string, validation_evidence string, confidence double, review_status string"
USAGE = "request_id string, model string, phase string, agent string, input_tokens long, output_tokens long, cached_tokens long, reasoning_tokens long, total_tokens long, latency_seconds double, retry_count long, token_measurement string, is_cached boolean, error string"
VALIDATION = "status string, confidence double, reason string, missing_evidence array<string>, recommended_manual_check string"
ANNOTATION = "struct<name:string,raw:string,line:int>"
ENDPOINT = "struct<http_method:string,path:string,annotation:string>"
METHOD = f"struct<name:string,class_name:string,file:string,start_line:int,end_line:int,visibility:string,return_type:string,parameters:string,annotations:array<{ANNOTATION}>,endpoint:{ENDPOINT},calls:array<string>>"
IMPORT = "struct<statement:string,is_static:boolean,is_wildcard:boolean,line:int>"
CLASS = f"file string, class_ord int, name string, qualified_name string, package string, kind string, visibility string, start_line int, end_line int, annotations array<{ANNOTATION}>, extends string, implements array<string>, methods array<{METHOD}>, imports array<{IMPORT}>"
EDGE = "caller_class string, caller_method string, callee_method string, file string, caller_line int"
SARIF = "struct<runs:array<struct<tool:struct<driver:struct<name:string,rules:array<struct<id:string,name:string,shortDescription:struct<text:string>,properties:struct<tags:array<string>>>>>>,results:array<struct<id:string,ruleId:string,level:string,message:struct<text:string>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:string,endLine:string>>>>>>>>>"

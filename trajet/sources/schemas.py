"""Explicit schemas; nothing in this library infers one from data."""

OBSERVATION = "struct<timestamp:bigint,confidence:string,statement:string,sub_details:array<string>,source_turn:int>"
COMPACTION_EVENT = f"struct<type:string,turn_index:int,before_bytes:bigint,after_bytes:bigint,llm_cost_usd:double,observations:array<{OBSERVATION}>,observer_raw_text:string>"
RECALL_EVENT = "struct<recall_id:string,tool_name:string,reason:string,turn_index:int>"
TURN = (
    "struct<turn_index:int,input_tokens:bigint,output_tokens:bigint,cache_read_input_tokens:bigint,cache_creation_input_tokens:bigint,wall_clock_ms:bigint,"
    f"ttfb_ms:bigint,class_signal:struct<class:string,confidence:double>,recall_events:array<{RECALL_EVENT}>,compaction_events:array<{COMPACTION_EVENT}>>"
)
SCORE = "struct<primary:double,secondary:map<string,double>,judge_explanation:string,judge_cost_usd:double,tool_coherence:struct<required_called:int,required_total:int,pass:boolean>>"
RUN_RECORD = (
    f"run_id string, bench string, config_id string, seed int, task_id string, started_at bigint, completed_at bigint, score {SCORE}, "
    "totals struct<input:bigint,output:bigint,cache_read:bigint,cache_creation:bigint>, cost_usd double, "
    f"turns array<{TURN}>, errors array<struct<turn_index:int,kind:string,message:string>>, final_response_text string"
)
RUN_SUMMARY = "bench string, config_id string, seed int, n_total bigint, n_completed bigint, mean_primary_score double, total_cost_usd double, status string, halt_reason string"
PART = "struct<type:string,text:string,mimeType:string,data:string,tool_use_id:string,name:string,input:string,output:string,isError:boolean>"
MESSAGE = f"struct<role:string,content:array<{PART}>,metadata:struct<turn_index:int,step_index:int,is_offloaded_pointer:boolean>>"
FILE_QA_TASK = "idx int, question string, answer string, level string, has_file boolean, file_path string"
MULTI_SESSION_TASK = (
    "question_id string, question_type string, haystack_sessions array<array<struct<role:string,content:string>>>, haystack_session_ids array<string>, "
    "haystack_dates array<string>, question string, answer string"
)
KEYED_SESSION_TASK = "sample_id string, qa_idx int, category int, category_name string, question string, answer string, evidence array<string>, conversation variant"
RETAIL_USER = (
    "user_id string, name struct<first_name:string,last_name:string>, email string, address struct<address1:string,address2:string,city:string,country:string,state:string,zip:string>, "
    "payment_methods map<string,struct<source:string,brand:string,last_four:string,id:string,balance:double>>, orders array<string>"
)

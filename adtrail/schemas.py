"""Explicit schemas of the tables that the sources produce."""

NODE = "struct<frame_id:string,kind:string,value:string,value2:string>"
HOP = "struct<frame_id:string,kind:string,value:string,value2:string,reason:string>"
ADS = (
    "log_id string, screenshot string, screenshot_hash string, event_log string, "
    f"redirections array<{HOP}>, home_url string, ad_url string, src_file string, line_no bigint"
)
EVENTS = (
    "log_id string, seq bigint, header string, fields map<string,string>, "
    "args map<string,string>, attrs map<string,string>"
)
EDGES = f"log_id string, dst {NODE}, src {NODE}, reason string, seq bigint, policy int"
CRAWL_RESULTS = (
    "log_id string, tabs_opened string, error string, ads_opened string, total_time string, "
    "job_name string, agent string, domain string, ip_type string, machine_ip string"
)
MILK1_RESULTS = (
    "log_id string, error string, image_hash string, loaded_url string, "
    "downloaded_files string, total_time string, job_name string, agent string, "
    "machine_ip string"
)
MILK2_RESULTS = MILK1_RESULTS + ", loaded_sld string, file_hashes array<string>, timestamp double"
CATEGORY_LINES = "domain string, category array<struct<name:string>>"

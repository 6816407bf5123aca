"""Header keywords, sheet names and vendor layouts. Users may edit or extend all of them."""

from __future__ import annotations

# Standard key -> header names that stand for it.
INSPECTION = {
    "depth": ["depth", "defect depth", "Max. Depth", "dimp", "depth (%)", "depth (mm)", "Peak Depth", "Peak Depth (% WT)", "Feature Depth", "Max Depth", "Max. Depth (%)", "Depth (%)", "As-Reported Anomaly Depth (%WT)", "Feature Depth (%WT for Corrosion & Cracks, %OD for Dents)"],
    "length": ["length", "Length", "defect length", "Limp", "length (mm)", "Feature Length", "Feature Length (mm)", "Length (in)", "Length (in.)", "Joint Length", "Joint Length (m)", "Pipe Length", "Pipe Length (m)", "Jt Length"],
    "width": ["width", "Width", "defect width", "Wimp", "width (mm)", "Feature Width", "Feature Width (mm)", "Width (in)", "Width (in.)"],
    "distance": ["distance", "Distance", "Odometer", "Log Distance", "Chainage", "Wheel Count (ft)", "Wheel Count (ft.)", "Log Dist.", "ILI Chainage (m)", "Odometer (m)", "ILI Chainage/Odometer (m)", "ILI Chainage", "ILI Distance (m)", "Distance from TGW (m)", "Distance from TGW", "US GWD ILI Chainage (m)", "US GWD ILI Chainage", "US GWD Chainage (m)", "US ILI Chainage (m)", "US Chainage (m)", "US Chainage", "US Odometer (m)", "US Odometer", "US Odo (m)", "US Odo", "U/S GWD ILI Chainage (m)", "U/S GWD Chainage (m)", "U/S Chainage (m)", "U/S Odometer (m)", "U/S Odometer", "U/S Odo (m)", "U/S Odo", "Upstream Chainage (m)", "Upstream Odometer (m)", "Upstream Odo (m)"],
    "feature_id": ["feature id", "feature", "id", "f_id", "Feature Number", "Anomaly ID", "ID", "FeatureID", "Target ID", "ID#", "Feature Identifier", "ILI Feature ID"],
    "feature_type": ["Feature Type", "Feature", "Event", "Anomaly Type", "Type"],
    "feature_desc": ["Feature Description", "Description", "Anomaly Description", "Anomaly", "Event"],
    "orientation": ["Orientation", "Clock Orientation", "O'Clock", "Orientation (clock)", "Clock Orient.", "Orientation (hh:mm)", "Feature Orientation", "Feature Orientation (Center of feature) (hh:mm)", "Feature Orientation (deg. or clock)", "(Degree)", "o'clock", "Seam Orientation", "Seam Orient.", "Seam Position", "Longseam Orientation", "Longseam Orient.", "Longseam (o'clock)", "LS Orientation", "LS Orient.", "LS Position", "Longseam Position"],
    "joint_number": ["Joint", "Joint Number", "Weld Number", "Joint No. or US GW No.", "Joint No", "US GW No", "PNG Joint Number", "Client Jno.", "GWD No.", "GWD No", "GWD #", "GWD#", "GWD", "US GWD", "U/S GWD", "PNG GWD", "PNG GWD No.", "Client GWD No.", "Weld No.", "Weld No", "Jt No.", "Jt No"],
    "source": ["ILI source", "Source", "ILI Vendor", "Vendor", "ILI Source"],
    "ds_distance": ["DS GWD ILI Chainage (m)", "DS GWD ILI Chainage", "DS GWD Chainage (m)", "DS ILI Chainage (m)", "DS Chainage (m)", "DS Chainage", "DS Odometer (m)", "DS Odometer", "DS Odo (m)", "DS Odo", "D/S GWD ILI Chainage (m)", "D/S GWD Chainage (m)", "D/S Chainage (m)", "D/S Odometer (m)", "D/S Odometer", "D/S Odo (m)", "D/S Odo", "Downstream Chainage (m)", "Downstream Odometer (m)", "Downstream Odo (m)"],
    "wall_thickness": ["Wall Thickness", "Wall Thickness (mm)", "Nom. WT", "Nom. WT (mm)", "Nominal WT", "Nominal WT (mm)", "Nominal Wall Thickness (mm)", "WT", "WT (mm)", "Thickness (mm)", "Wall Thk", "Wall Thk (mm)"],
    "pipe_grade": ["Grade", "Pipe Grade", "Material Grade", "Mat. Grade", "API Grade", "Specification", "Pipe Specification", "Material Specification", "Mat. Spec.", "Grade/Spec"],
}

# Header names of dig lists.
DIG_LIST = {
    "dig_id": ["Dig ID", "NEW Dig Name", "Excavation ID"],
    "dig_name": ["Dig Name", "DigName", "Dig Package Name"],
    "feature_id": ["Target Feature ID", "Feature ID", "ILI Feature ID", "ID#", "Feature Identifier", "Target ID"],
    "pipeline_name": ["Pipeline Name", "Pipeline_Name", "PipelineName", "Line Name"],
    "pipe_od": ["Pipe NPS", "NPS", "Pipe OD", "Pipe_OD", "PipeOD", "OD (mm)", "Pipe Diameter"],
    "pipe_nwt": ["Pipe NWT", "Pipe_NWT", "PipeNWT", "Nominal Wall Thickness (mm)", "Wall Thickness"],
    "mop": ["MOP", "MAOP", "Maximum Operating Pressure"],
    "sep": ["SEP", "Safe Excavation Pressure"],
    "latitude": ["TGW Lat", "Latitude", "Lat"],
    "longitude": ["TGW Long", "Longitude", "Lon", "Long"],
    "milepost": ["Milepost", "MP", "Mile Post"],
    "pipe_year": ["Pipe Year", "Year", "Installation Year"],
    "pipe_grade": ["Pipe Grade", "Grade", "Material Grade"],
    "ili_run_name": ["Originating ILI", "ILI Run Name", "ILI Run", "Run Name", "ILI Source", "ILI Vendor"],
    "ili_run_accuracy": ["ILI Time", "ILI Run Date", "ILI Run Accuracy", "Run Accuracy", "ILI Accuracy"],
    "upstream_agm": ["Upstream AGM", "US AGM", "US_AGM"],
    "downstream_agm": ["Downstream AGM", "DS AGM", "DS_AGM"],
    "assessment_length": ["Total Assessment Length", "Assessment Length", "Assess Length"],
    "start_assessment": ["Start Assessment", "Assessment Start", "US Assessment"],
    "end_assessment": ["End Assessment", "Assessment End", "DS Assessment"],
    "exposure_length": ["Exposure Length", "Expose Length"],
    "start_exposure": ["Start Exposure", "Exposure Start", "US Exposure"],
    "end_exposure": ["End Exposure", "Exposure End", "DS Exposure"],
    "target_girth_weld": ["Target Girth Weld (TGW)", "Target Girth Weld", "Target GW", "TGW", "Target Joint"],
    "length": ["Feature Length", "Length", "Length (mm)", "Length (in)"],
    "width": ["Feature Width", "Width", "Width (mm)", "Width (in)"],
    "dig_revision": ["Dig Package Revision", "Revision", "Rev"],
    "feature_type": ["Feature Type", "Anomaly Type"],
    "anomaly_description": ["Anomaly Description", "Feature Description", "Description"],
    "class_location": ["Class Location", "Class"],
    "required_completion_date": ["Required Completion Date", "Completion Date"],
    "issue_date": ["Dig Issuance / Revision / Cancellation Date", "Dig Issuance", "Issuance / Revision / Cancellation Date", "Dig Issuance Date", "Package Issuance Date", "Issuance Date"],
}

# Vendor layouts, by the layout's name; several names share one.
_MFL_LAYOUT = {
    "feature_id": ["ID#", "Feature Identifier", "Feature ID", "ILI Feature ID"],
    "feature_type": ["Feature Type", "Feature", "Event"],
    "feature_desc": ["Feature Description", "Description", "Anomaly"],
    "length": ["Length (mm)", "Length (in)", "Length"],
    "width": ["Width (mm)", "Width (in)", "Width"],
    "depth": ["Depth (%)", "Max Depth", "Peak Depth"],
    "orientation": ["Orientation (clock)", "Clock Orient.", "Orientation (hh:mm)"],
    "distance": ["Wheel Count (ft)", "Log Dist.", "ILI Chainage (m)", "Odometer (m)"],
    "joint_number": ["Joint No. or US GW No.", "Joint No", "US GW No"],
}
_BH_LAYOUT = {
    "feature_id": ["ANOM ID", "Anomaly ID", "ID", "Feature ID"],
    "feature_type": ["Anomaly Type", "Type", "Feature Type", "Classification"],
    "feature_desc": ["Description", "Anomaly Description", "Feature Description", "Comment"],
    "length": ["Axial Length", "Length (mm)", "Length"],
    "width": ["Circ Width", "Width (mm)", "Width"],
    "depth": ["Depth (%)", "Depth", "Max Depth"],
    "orientation": ["Clock Position", "Orientation", "O'Clock"],
    "distance": ["Log Distance", "Chainage", "Odometer", "Distance (m)"],
    "joint_number": ["Joint No", "US Joint No", "Weld Number"],
}
_TDW_LAYOUT = {
    "feature_id": ["ID", "Feature Number", "FeatureID", "Target ID"],
    "feature_type": ["Type", "Feature Type", "Anomaly Type"],
    "feature_desc": ["Description", "Feature Description", "Anomaly Description"],
    "length": ["Length", "Length (in)", "Length (mm)"],
    "width": ["Width", "Width (in)", "Width (mm)"],
    "depth": ["Depth", "Depth (%)", "Max Depth"],
    "orientation": ["Orientation", "Clock Orientation", "O'Clock"],
    "distance": ["Chainage", "Odometer", "Distance"],
    "joint_number": ["Joint", "Joint Number", "Weld Number"],
}
VENDORS = {"TDW": _TDW_LAYOUT, "Rosen-MFLA": _MFL_LAYOUT, "Rosen-MFLC": _MFL_LAYOUT, "Rosen-EMAT": _MFL_LAYOUT, "BH-EMAT": _BH_LAYOUT, "BH-MFLA": _BH_LAYOUT}
DEFAULT_VENDOR = "Rosen-MFLA"
TALLY_SHEETS = ["Pipetally", "Pipe Tally", "Tally", "True", "Page-1", "PNG ILI Pipeline Tally"]
ANOMALY_SHEETS = ["Anomalies", "Anomaly", "Anomaly Listing"]
DIG_SHEETS = ["Dig Notification Log", "Features&Dig", "Features", "Dig"]
HEADER_WORDS = ["ili", "chainage", "distance", "depth", "feature", "length", "width", "orientation", "odometer"]
TALLY_WORDS = ["wall thickness", "wt (mm)", "nom. wt", "ds chainage", "ds odometer", "ds odo", "d/s chainage", "d/s odo"]
ALIASES = {
    "Equipment ID": ["Equipment ID", "Equipment #", "Equip ID", "EquipmentID"],
    "Circuit ID": ["Circuit ID", "Circuit #", "CircuitID", "Circuit Number"],
    "CML Group ID": ["CML Group ID", "CML Group", "TML Group ID", "CMLGroupID"],
    "sub-CML ID": ["sub-CML ID", "Sub CML ID", "TML_ID", "TML ID", "SubCMLID", "CML ID", "CML_ID", "CMLID"],
    "AER_Status_CML": ["AER_Status_CML", "AER Status CML", "AERStatusCML"],
    "Sort Field": ["Sort Field", "sort field", "SortField"],
}


def merged(base: dict[str, list[str]], override: dict[str, list[str]] | None = None) -> dict[str, list[str]]:
    """Override names come first; each name once, case and outer blanks aside; blank names stand for nothing and go."""
    out: dict[str, list[str]] = {}
    for key in dict.fromkeys([*base, *(override or {})]):
        kept: dict[str, str] = {}
        for n in [*(override or {}).get(key, []), *base.get(key, [])]:
            if n.strip():
                kept.setdefault(n.strip().lower(), n)
        out[key] = list(kept.values())
    return out


def vendor_keywords(vendor: str) -> tuple[dict[str, list[str]], list[str]]:
    """Keywords and sheet names of a vendor layout; an unknown one gets the default layout."""
    layout = VENDORS.get(vendor, VENDORS[DEFAULT_VENDOR])
    return merged(INSPECTION, layout), ANOMALY_SHEETS if "Rosen" in vendor else TALLY_SHEETS
